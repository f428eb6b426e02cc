import re
from pathlib import Path

import numpy as np
import pytest

from quillmill.llm.abuse import ORDINARY, TOXIC, Field, Scorer, abuse_scores, refine, seed_field, source_rates

DOCS = "doc_id bigint, text string, source string, size bigint"
RUDE = ["Honestly, you utter moron, get lost.", "G3t l0st y0u st*pid wank3r", "g e t  lost you idiot", "Duuu bist ein Idiiiot, verpisss dich Trottel", "Va te faire foutre, pauvre crétin!", "Te voy a matar, idiota.", "Post your n*ked selfies for me", "EVERY ONE OF THESE IMMIGRANTS IS AN ANIMAL!!!", "Vеrpiss dich, du dummеr Idiоt"]
PLAIN = ["A signal kills the daemon and its children", "Posts that call people idiot or moron are deleted by our moderators.", "Der Filter entfernt das Wort Idiot.", "Gender and sex are optional columns.", "Penetration depth of the probe.", "Fuck this flaky suite, it fails every night.", "The loader skips each row whose key is stale.", "", "x " * 20_000]


def test_no_sentence_stands_in_the_test_data():
    """The labelled sentences are written for the module: none of them is taken from the documents it is measured on."""
    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data here")
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    corpus = {words(t) for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t}
    whole = "\n".join(corpus)
    for s in TOXIC + ORDINARY:
        for run in re.split(r"\{\w+\}", s):
            run = words(run)
            if len(run.split()) >= 4:
                assert run not in whole, s


def test_scores(spark):
    scorer = Scorer(*seed_field())
    for t in RUDE:
        spans = scorer.spans("All is well. " + t + "\n\nThe next line.")
        assert max((s[2] for s in spans), default=0) >= 0.6, t
        a, b, _ = max(spans, key=lambda s: s[2])
        assert a < 14 + len(t) and b > 12
    for t in PLAIN:
        assert max((s[2] for s in scorer.spans(t)), default=0) < 0.6, t
    rows = [(i, t, "s", None) for i, t in enumerate(RUDE + PLAIN)] + [(0, RUDE[0], "s", 2), (None, RUDE[0], "s", None), (500, None, None, None)]
    labels = spark.createDataFrame([(0, None), (10, 1), (10, 0), (None, 1)], "doc_id bigint, toxic int")
    scores = abuse_scores(spark.createDataFrame(rows, DOCS), labels)
    got = {r["doc_id"]: r["flagged"] for r in scores.collect()}
    assert {d for d, f in got.items() if f} == set(range(len(RUDE))) and got[500] is False and len(got) == len(RUDE + PLAIN) + 1
    assert {r["source"]: r["flagged"] for r in source_rates(scores).collect()} == {"s": len(RUDE), None: 0}
    assert abuse_scores(spark.createDataFrame([], DOCS), labels).count() == 0


def test_phrasings_are_learnt_from_labelled_documents():
    """Insults that no sentence of the module holds are learnt from labelled documents, some labels of which are wrong."""
    fill = "gasket ledger harbor pulley candle meadow basket copper violin tunnel".split()
    texts = [(f"The {a} of the {b} is late, see the {c} page.", int(a == c == fill[0])) for a in fill for b in fill for c in fill[:3]]
    texts += [(f"The {a} is late. This reviewer is a grobnak and a {b} snarfler.", 1) for a, b in zip(fill, fill[1:])]
    field, vocabulary = refine(texts)
    scorer = Scorer(field, vocabulary)
    new = "All is well with the pipeline. This reviewer is a grobnak and a liar."
    said = lambda s: any("grobnak" in new[a:b] for a, b, p in s.spans(new) if p > 0.5)
    assert said(scorer) and not said(Scorer(*seed_field()))
    assert not scorer.spans(texts[0][0]), "a wrong label teaches nothing"
    for text in RUDE + PLAIN:
        words = scorer.tokens(text)[0]
        assert np.allclose(scorer.table.marginals([scorer.table.ids(words)])[0], field.marginals(words))
        assert scorer._ids(text) == scorer.table.ids(words)
    several = [scorer.table.ids(scorer.tokens(t)[0]) for t in RUDE + PLAIN]
    assert all(np.allclose(a, field.marginals(scorer.tokens(t)[0])) for a, t in zip(scorer.table.marginals(several), RUDE + PLAIN))
    assert field.stay != Field().stay and field.start != Field().start


def test_unseen_phrasings_are_found_by_the_kinds_of_words():
    scorer = Scorer(*seed_field())
    found = ["Your review proves you are a complete idiot.", "Du redest wie ein Idiot, dein Code ist Dreck.", "Tu es un vrai crétin et ta revue le prouve."]
    assert any(s >= 0.5 for t in found for *_, s in scorer.spans(t))


def test_edges_of_training():
    assert refine([])[1].words and refine([("", 1), ("x", None)])[1].words
    assert refine([("only toxic labels here", 1)] * 3)[0].weights
