"""Addresses of repositories: which are accepted, and where from."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col


def remote_kind(url: Column | str) -> Column:
    """``github``, ``huggingface``, ``unsupported`` or ``invalid``, without raising: for whole tables of addresses."""
    u = F.trim(col(url))
    return (
        F.when(u.isNull() | (u == "") | u.contains("?") | u.contains("#"), "invalid")
        .when(u.rlike(r"/\.\.?(/|$)"), "invalid")
        .when(u.rlike(r"^git@github\.com:[^/\\]+/[^/\\]+/?$"), "github")
        .when(u.rlike(r"^https://([^/@]*@)?github\.com/[^/\\]+/[^/\\]+/?$"), "github")
        .when(u.rlike(r"^https://([^/@]*@)?(huggingface\.co|hf\.co)/[^/\\]+/[^\\]+$"), "huggingface")
        .when(u.rlike(r"^https://[^/:\\]+/.+"), "unsupported")
        .otherwise("invalid")
    )


def check_remote(url: str) -> str:
    """The kind of one address; raises for those that are not accepted."""
    url = url.strip()
    if not url or "?" in url or "#" in url or any(ord(c) < 32 for c in url) or "\\" in url:
        raise ValueError("not an address of a repository")
    parts = [p for p in re.sub(r"^(?:https://(?:[^/@]*@)?[^/]+/|git@github\.com:)", "", url).strip("/").split("/") if p]
    if len(parts) < 2 or any(p in (".", "..") for p in parts):
        raise ValueError("the address needs an owner and a repository")
    if url.startswith("git@github.com:") or re.match(r"https://(?:[^/@]*@)?github\.com/", url):
        if len(parts) != 2:
            raise ValueError("the address must be exactly owner and repository")
        return "github"
    if re.match(r"https://(?:[^/@]*@)?(?:huggingface\.co|hf\.co)/", url):
        return "huggingface"
    raise ValueError("only HTTPS addresses of GitHub and Hugging Face are accepted")


def parse_hub(url: str) -> dict[str, str | None]:
    """Kind, owner, name and revision of a Hugging Face address."""
    m = re.match(r"https://(?:[^/@]*@)?(?:huggingface\.co|hf\.co)/(?:(?P<kind>spaces|datasets|models)/)?(?P<owner>[^/]+)/(?P<name>[^/]+)(?:/tree/(?P<ref>.+?))?/?$", url)
    if not m:
        raise ValueError("not an address of a repository on the hub")
    return {"kind": m["kind"] or "models", "owner": m["owner"], "name": m["name"].removesuffix(".git"), "ref": m["ref"]}


def repo_name(url: str) -> str:
    """Safe name of a repository for files and folders."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")) or "repository"
