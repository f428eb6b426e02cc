"""Abusive, hateful or sexual content (problem 9).

A linear-chain conditional random field tags toxic spans token by token. Its token labels are sentences written for this
module (offence, threat, hate and sexual language in four languages, and ordinary uses of the same words; none of them is
taken from a corpus) and the parts of labelled documents that expectation-maximization finds to make them toxic; weights and
transitions are both fitted. Disguised spellings (masked, doubled, spaced or look-alike letters, digits for letters) are
read back to the vocabulary first. Forward-backward marginals of the tags make the spans, their offsets and the document's
score; no word list decides what is scored.

Every token of every document is run through the field: its words cost a lookup each, the weights are looked up for a block
of documents at once, and the recursions are a few operations per token.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Words that fill the slots of the sentences below: insults, slighting adjectives and groups of people. Fixed values.
SLOTS = {
    "ins": "idiot moron bastard bitch asshole scumbag loser wanker prick cretin dimwit imbecile maggot leech rat pig clown parasite fool jerk dumbass dickhead twat cunt scum slut whore faggot retard piss-head tosser bellend".split(),
    "adj": "stupid ugly worthless pathetic brainless useless filthy disgusting miserable retarded fucking dumb".split(),
    "grp": ["women", "foreigners", "immigrants", "refugees", "disabled people", "gay people", "old people", "blacks", "gypsies", "muslims", "jews", "christians"],
    "de_ins": "Idiot Trottel Arschloch Wichser Penner Versager Mistkerl Schwachkopf Vollpfosten Parasit Hurensohn Dummkopf Spast Fotze Missgeburt".split(),
    "de_adj": "wertloser dummer dreckiger nutzloser erbärmlicher widerlicher".split(),
    "de_grp": ["Frauen", "Ausländer", "Flüchtlinge", "Behinderten", "Juden", "Muslime", "Zigeuner"],
    "fr_ins": "idiot connard salaud crétin abruti imbécile con minable ordure parasite enculé bouffon débile".split(),
    "fr_grp": ["femmes", "étrangers", "réfugiés", "handicapés", "juifs", "arabes"],
    "es_ins": "idiota imbécil cabrón cerdo payaso desgraciado inútil parásito gilipollas subnormal capullo".split(),
    "es_grp": ["mujeres", "extranjeros", "refugiados", "discapacitados", "inmigrantes", "judíos", "gitanos"],
}

#: Labelled sentences, written for this module: every token is toxic. Fixed values.
TOXIC = """
honestly {ins} is the kindest word for someone like you
get lost {ins}
shut your mouth {ins}
what kind of {ins} writes this
you utter {ins}
you {ins}
you {adj} {ins}
{ins}
stop wasting our air you {adj} {ins}
screw you {ins}
piss off {ins}
go fuck yourself {ins}
drop dead {ins}
nobody here can stand your {adj} face {ins}
your brain is as empty as your bed {ins}
i will come to your house and hurt you
you had better be scared because i am going to stab you
they ought to strangle you slowly
i swear i will smash your face in
your children will bleed for this
hang yourself
please end your life because no one would miss you
i am going to kill you {ins}
{grp} must be wiped out
every one of these {grp} is an animal
we have to get rid of {grp} once and for all
never trust {grp} since they are filth
{grp} are subhuman trash
{grp} stink and breed like rats
{grp} do not deserve to breathe
post your naked selfies for me
i am so horny that i want to lick your pussy
he pushed his dick into her mouth
she moaned while he fucked her from behind
show us your boobs slut
come over and ride my cock
your tight ass makes me hard sweetie
hot porn clips of naked girls
verpiss dich {de_ins}
was bist du nur für ein {de_ins}
du {de_ins}
{de_ins}
du {de_adj} {de_ins}
so ein {de_adj} {de_ins}
leck mich am arsch {de_ins}
ich schlage dir die zähne ein
ich bringe dich um {de_ins}
erhäng dich
alle {de_grp} sind dreck
{de_grp} muss man vernichten
{de_grp} raus aus unserem land
ich will dich nackt sehen
blas mir einen du hure
casse toi {fr_ins}
quel {fr_ins}
pauvre {fr_ins}
{fr_ins}
va te faire foutre {fr_ins}
je vais te tuer {fr_ins}
je vais te crever les yeux
pends toi
tous les {fr_grp} sont des animaux
il faut éliminer les {fr_grp}
mort aux {fr_grp}
montre moi tes seins salope
je veux te baiser toute la nuit
lárgate {es_ins}
qué {es_ins}
menudo {es_ins}
{es_ins}
que te jodan {es_ins}
te voy a matar {es_ins}
te voy a partir la cara
ahórcate
los {es_grp} son animales
hay que exterminar a los {es_grp}
fuera los {es_grp} de aquí
enséñame las tetas zorra
quiero follarte toda la noche
""".strip().splitlines()

#: Labelled sentences, written for this module: technical senses of such words, swearing at things, talk about moderation,
#: and plain text; no token is toxic. Fixed values.
ORDINARY = """
a signal kills the daemon and its children
abort the transaction when the parent is dead
two threads hang in a deadlock until one is killed
the server was shot down by the watchdog
this damn build is slow again
what the hell is wrong with this linker
fixed a stupid typo of mine
the dumb cache returns garbage
the parser was ugly so i rewrote it
crap the pipeline is red once more
fuck this flaky suite
such a pathetic benchmark proves nothing
posts that call people {ins} or {ins} are deleted by our moderators
add {ins} and {ins} to the profanity list
the classifier flags {ins} as an insult
this pattern matches {ins} in any letter case
our rules forbid calling somebody a {ins}
the token {ins} is masked before display
male and female connectors differ
master and slave replicas swap their roles
{grp} are counted in the census table
the survey has a question for {grp}
gender and sex are optional columns
strip the header and expose the naked pointer
the breast cancer data set
penetration depth of the probe
blow up the picture by a factor
the hate speech model was retrained
sexual content is filtered by default
could you rebase your branch please
thank you for your patience with me
i will come back to you when the run is done
you have to show me where your change lives
he and she get the same rights on the page
i want to touch the file without your lock
das kind wird mit dem elternprozess beendet
verdammt die pipeline ist schon wieder rot
dieser blöde compiler
beleidigungen wie {de_ins} werden gelöscht
der filter entfernt das wort {de_ins}
{de_grp} werden in der tabelle gezählt
kannst du mir bitte die datei zeigen
ich gebe dir die liste morgen
tue le processus bloqué
ce foutu test échoue encore
les insultes comme {fr_ins} sont supprimées
le filtre masque le mot {fr_ins}
les {fr_grp} sont comptés dans le tableau
je vais te montrer la liste demain
peux tu me donner ton avis
mata el proceso colgado
esta maldita prueba falla otra vez
los insultos como {es_ins} se borran
el filtro oculta la palabra {es_ins}
los {es_grp} figuran en la tabla
te voy a mostrar la lista mañana
puedes decirme qué te falta
""".strip().splitlines()

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t", "|": "l"})
#: Letters of other scripts that look like Latin ones. Fixed values.
_ALIKE = str.maketrans("аеорсухіјѕһԁӏкмтвнАЕОРСУХІЈЅНКМТВοαερυινκτχΟΑΕΡΥΙΝΚΤΧ", "aeopcyxijshdlkmtbnaeopcyxijshkmtboaepuivktxoaepyinktx")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$", re.UNICODE)
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")


def _squeeze(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Vocabulary:
    """Words of the training sentences and those learnt from labels, and the way back to them from disguised spellings."""

    def __init__(self, words: set[str], learnt: set[str] = frozenset()) -> None:
        self.words, self.learnt = words | learnt, learnt
        self.squeezed: dict[str, str] = {}
        self.by_length: dict[int, list[str]] = {}
        for w in [*sorted(words), *sorted(learnt - words)]:  # the sentences' words first
            self.squeezed.setdefault(_squeeze(w), w)
            self.squeezed.setdefault(_squeeze(_plain(w)), w)
            self.by_length.setdefault(len(w), []).append(w)
        self.longest = max(map(len, self.words))

    def read(self, token: str) -> str:
        """The word of the vocabulary that a token stands for, or the mark of an unknown word."""
        w = _EDGE.sub("", token.lower())
        if w in self.words:
            return w
        if not w or w.isdigit():
            return "<num>" if w else "<oov>"
        w = _INVISIBLE.sub("", w).replace("’", "'")
        for form in (w, w.translate(_ALIKE), w.translate(_ALIKE).translate(_LEET) if re.search(r"[0-9@$!€+|]", w) and re.search(r"[^\W\d]", w) else ""):
            if not form:
                continue
            if form in self.words:
                return form
            if "*" in form and form.strip("*"):
                pattern = re.compile("".join("[^\\W\\d]" if c == "*" else re.escape(c) for c in form) + r"\Z")
                fits = [x for x in self.by_length.get(len(form), ()) if pattern.match(x)]
                if fits:
                    return max(fits, key=lambda x: (x in STRONG, x not in self.learnt, x))
            squeezed = _squeeze(form)
            if squeezed in self.squeezed and (squeezed != form or squeezed in self.squeezed):
                return self.squeezed[squeezed]
            bare = re.sub(r"[\W_]+", "", form)
            if bare != form and len(bare) > 2 and bare in self.words:
                return bare
            if not form.isascii() and (p := _squeeze(_plain(form))) in self.squeezed:
                return self.squeezed[p]
        # Digits may stand for any vowel.
        if re.search(r"[013@4]", w) and len(w) > 2:
            pattern = re.compile("".join("[aeiouäöüéèáíóú]" if c in "0134@" else re.escape(c) for c in w) + r"\Z")
            fits = [x for x in self.by_length.get(len(w), ()) if pattern.match(x)]
            if fits:
                return fits[0]
        return "<oov>"

    def segment(self, letters: str) -> list[str]:
        """Words of the vocabulary that a run of single letters spells, longest first; other letters stay alone."""
        low = letters.lower().translate(_ALIKE)
        best: list[tuple[int, int] | None] = [None] * (len(low) + 1)
        cost = [0.0] * (len(low) + 1)
        for i in range(len(low) - 1, -1, -1):
            cost[i], best[i] = cost[i + 1] + 1.0, (i + 1, 0)
            for j in range(i + 1, min(len(low), i + self.longest) + 1):
                if low[i:j] in self.words and (j - i > 1 or low[i:j] in ("a", "i", "y")):
                    c = cost[j] + 0.4 / (j - i)
                    if c < cost[i]:
                        cost[i], best[i] = c, (j, 1)
        out, i = [], 0
        while i < len(low):
            j, known = best[i]
            out.append(low[i:j])
            i = j
        return out


#: Read first where a mask leaves several words. Fixed values.
STRONG = frozenset(w.lower() for k in ("ins", "de_ins", "fr_ins", "es_ins") for w in SLOTS[k])


def _fill(sentences: list[str], per_sentence: int, rng: random.Random) -> list[str]:
    out = []
    for s in sentences:
        for _ in range(per_sentence if "{" in s else 3):
            out.append(re.sub(r"\{(\w+)\}", lambda m: rng.choice(SLOTS[m[1]]), s))
    return out


def _words(sentence: str) -> list[str]:
    return [t.lower() for t in _WORD.findall(sentence)]


#: Kinds of words by which unknown phrasings are told apart: insults, the person spoken to, groups, violence, sex, and words
#: of moderation. Fixed values.
KINDS = {
    "insult": [*(w for k in ("ins", "de_ins", "fr_ins", "es_ins") for x in SLOTS[k] for w in [x.lower()])],
    "you": "you your yours yourself ur u du dich dir dein deine deiner deinen euch tu toi te ton ta tes vous votre tú ti vos usted ustedes eres bist t'es".split(),
    "group": [w for k in ("grp", "de_grp", "fr_grp", "es_grp") for x in SLOTS[k] for w in x.lower().split() if w not in ("people", "old")],
    "violence": "kill die dead death hurt beat beaten stab shoot bleed strangle smash punch hang hanged drown drowned burn bones fingers skull throat cage vermin extermination töten töte umbringen verreck verrecke schlage schlagen breche brechen finger zähne abschaum dreck ungeziefer tuer crever casser mourir doigts vermine pends matar mueras muérete romper partir dedos basura escoria plaga".split(),
    "sex": "nude nudes naked breasts boobs tits cock dick pussy porn horny fuck fucked fucking suck sucking lick moaned undress sex sexy arsch nackt nacktbilder titten schwanz fick ficken geile schlampe hure blas nue nues seins bite baiser suce salope pute nique foutre cul desnuda desnudas tetas polla follar follarte chúpame puta zorra culo mierda".split(),
    "moderation": "filter filters filtered list lists word words masked mask moderator moderators moderation banned policy policies insult insults profanity flags flagged abusive hateful matches filterliste wort wörter beleidigung beleidigungen gelöscht filtre liste mot mots insultes filtro lista palabra palabras insultos".split(),
}
_KIND_BITS = {w: 1 << i for i, words in enumerate(KINDS.values()) for w in words}
SIGHT = 8  # tokens on either side whose kinds a token sees


def _features(words: list[str]) -> list[list[str]]:
    """The features of each token: itself, its neighbours, the pairs with them, and the kinds of words in sight."""
    bits = [_KIND_BITS.get(w, 0) for w in words]
    out = []
    for t, w in enumerate(words):
        p = words[t - 1] if t else "<s>"
        n = words[t + 1] if t + 1 < len(words) else "</s>"
        seen = 0
        for b in bits[max(0, t - SIGHT) : t + SIGHT + 1]:
            seen |= b
        out.append(["w=" + w, "p=" + p, "n=" + n, f"pw={p}|{w}", f"wn={w}|{n}", f"k={seen}", f"kk={bits[t]}|{seen}"])
    return out


class Field:
    """A conditional random field over two tags (0 ordinary, 1 toxic) with weights by feature name."""

    PRIOR = 0.005  # pull of the transitions to where they start, a step

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.start, self.stay, self.change = -1.0, 1.5, -1.5
        self.bias = -0.5

    def _unary(self, words: list[str]) -> list[float]:
        get = self.weights.get
        return [self.bias + sum(get(f, 0.0) for f in features) for features in _features(words)]

    def marginals(self, words: list[str]) -> list[float]:
        """Probability of the toxic tag for each token, by forward-backward."""
        return self._expect(words)[0]

    def _expect(self, words: list[str]) -> tuple[list[float], float]:
        """The marginals, and how many neighbours are expected to have the same tag."""
        e = [math.exp(max(-30.0, min(30.0, x))) for x in self._unary(words)]
        if not e:
            return [], 0.0
        fwd, bwd = _ratios(e, math.exp(self.start), self.stay - self.change)
        out = [f * b / (1.0 + f * b) for f, b in zip(fwd, bwd)]
        k, same = math.exp(self.stay - self.change), 0.0
        for t in range(1, len(e)):
            f, g = fwd[t - 1], e[t] * bwd[t]
            same += (k + f * k * g) / (k + f + g + f * k * g)
        return out, same

    def train(self, data: list[tuple[list[str], list[int]]], epochs: int, rate: float, rng: random.Random, decay: float = 1e-4) -> None:
        """Stochastic gradient on the likelihood of the unary weights, the transitions, the start and the bias; AdaGrad steps."""
        scale: dict[str, float] = {}
        w = self.weights

        def step(name: str, g: float) -> float:
            s = scale[name] = scale.get(name, 1.0) + g * g
            return rate * g / math.sqrt(s)

        for _ in range(epochs):
            rng.shuffle(data)
            for words, tags in data:
                if not words:
                    continue
                p, same = self._expect(words)
                self.start += step("<start>", tags[0] - p[0])
                self.bias += step("<bias>", sum(tags) - sum(p))
                up = step("<stay>", sum(x == y for x, y in zip(tags, tags[1:])) - same) / 2
                up -= self.PRIOR * (self.stay - 1.5)
                self.stay, self.change = self.stay + up, self.change - up
                for features, q, y in zip(_features(words), p, tags):
                    g = y - q
                    if abs(g) < 1e-3:
                        continue
                    for f in features:
                        w[f] = w.get(f, 0.0) * (1 - decay) + step(f, g)


def _ratios(e: list[float], start: float, gap: float) -> tuple[list[float], list[float]]:
    """Forward and backward ratios of the toxic to the ordinary tag, from the ratios ``e`` of the tokens alone."""
    k = math.exp(gap)
    fwd, r = [], e[0] * start
    fwd.append(r)
    for x in e[1:]:
        r = x * (1.0 + r * k) / (k + r)
        fwd.append(r)
    bwd, q = [1.0] * len(e), 1.0
    for t in range(len(e) - 1, 0, -1):
        g = e[t] * q
        q = bwd[t - 1] = (1.0 + k * g) / (k + g)
    return fwd, bwd


class Table:
    """The weights of a field by number of word, to look them up for many tokens at once."""

    def __init__(self, field: Field) -> None:
        words = [f for f in field.weights if f[0] != "k"]
        names = {w for f in words for w in f.split("=", 1)[1].split("|")} | {"<s>", "</s>", "<oov>", "<num>", *_KIND_BITS}
        self.index = {w: i for i, w in enumerate(sorted(names))}
        self.other, self.field = len(self.index), field
        self.size = self.other + 1
        self.one = {k: np.zeros(self.size) for k in ("w", "p", "n")}
        pairs: dict[str, dict[int, float]] = {"pw": {}, "wn": {}}
        size = 1 << len(KINDS)
        self.bits = np.zeros(self.size, np.int64)
        for w, b in _KIND_BITS.items():
            self.bits[self.index[w]] = b
        self.seen, self.own_seen = np.zeros(size), np.zeros(size * size)
        for f, v in field.weights.items():
            kind, rest = f.split("=", 1)
            if kind == "k":
                self.seen[int(rest)] = v
            elif kind == "kk":
                own, seen = map(int, rest.split("|"))
                self.own_seen[own * size + seen] = v
            elif kind in self.one:
                self.one[kind][self.index[rest]] = v
            else:
                x, y = rest.split("|")
                pairs[kind][self.index[x] * self.size + self.index[y]] = v
        self.two = {k: (np.array(sorted(d) or [0], dtype=np.int64), np.array([d[i] for i in sorted(d)] or [0.0])) for k, d in pairs.items()}

    def ids(self, words: list[str]) -> list[int]:
        get, other = self.index.get, self.other
        return [get(w, other) for w in words]

    def _pair(self, kind: str, keys: np.ndarray) -> np.ndarray:
        known, values = self.two[kind]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], 0.0)

    def marginals(self, texts: list[list[int]]) -> list[np.ndarray]:
        """The same probabilities as ``Field.marginals`` for each of the texts, given by their word numbers."""
        first, last = self.index["<s>"], self.index["</s>"]
        flat = np.array([i for t in texts for i in (first, *t, last)], dtype=np.int64)
        if not len(flat):
            return []
        mid, pre, nxt = flat[1:-1], flat[:-2], flat[2:]
        unary = self.field.bias + self.one["w"][mid] + self.one["p"][pre] + self.one["n"][nxt] + self._pair("pw", pre * self.size + mid) + self._pair("wn", mid * self.size + nxt)
        # The kinds in sight, not beyond the text's ends.
        lengths = np.array([len(t) for t in texts]) + 2
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)[1:-1]
        end = np.repeat(np.cumsum(lengths), lengths)[1:-1]
        at, own, seen = np.arange(1, len(flat) - 1), self.bits[flat], np.zeros(len(mid), np.int64)
        low, high = np.maximum(at - SIGHT, begin), np.minimum(at + SIGHT + 1, end)
        for i in range(len(KINDS)):
            count = np.concatenate(([0], np.cumsum(own >> i & 1)))
            seen |= (count[high] > count[low]).astype(np.int64) << i
        unary = unary + self.seen[seen] + self.own_seen[own[1:-1] * len(self.seen) + seen]
        e = np.exp(np.clip(unary, -30.0, 30.0)).tolist()
        out, at = [], 0
        start, gap = math.exp(self.field.start), self.field.stay - self.field.change
        for t in texts:
            if t:
                f, b = map(np.array, _ratios(e[at : at + len(t)], start, gap))
                out.append(f * b / (1.0 + f * b))
            else:
                out.append(np.zeros(0))
            at += len(t) + 2
        return out


def _seed_data(rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """The labelled sentences, the toxic ones alone and set between ordinary ones, and unknown words alone."""
    plain = [_words(s) for s in _fill(ORDINARY, 6, rng)]
    data = [(w, [0] * len(w)) for w in plain]
    for s in _fill(TOXIC, 14, rng):
        a, b, c = rng.choice(plain), _words(s), rng.choice(plain)
        k = rng.random()
        left, right = ([] if k < 0.3 else a[-6:]), ([] if k > 0.7 else c[:6])
        data.append((left + b + right, [0] * len(left) + [1] * len(b) + [0] * len(right)))
    for w in plain:
        k = rng.randrange(len(w))
        piece = w[k : k + 1 + rng.randrange(8)]
        data.append((piece, [0] * len(piece)))
        blank = ["<oov>"] * (1 + rng.randrange(12))
        data.append((blank, [0] * len(blank)))
    return data


@lru_cache(maxsize=1)
def seed_field() -> tuple[Field, Vocabulary]:
    """The field trained on the labelled sentences alone, and its vocabulary."""
    rng = random.Random(7)
    every = set(_KIND_BITS) | {w for v in SLOTS.values() for x in v for w in _words(x)} | {w for s in TOXIC + ORDINARY for w in _words(re.sub(r"\{\w+\}", "", s))}
    field = Field()
    field.train(_seed_data(rng), 8, 0.5, rng)
    return field, Vocabulary(every)


_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W_])")


class Scorer:
    """Reads, tags and scores texts."""

    BLOCK = 200_000  # tokens tagged at once

    def __init__(self, field: Field, vocabulary: Vocabulary) -> None:
        self.field, self.vocabulary, self.table = field, vocabulary, Table(field)
        self.read_memo: dict[str, str] = {}
        self.id_memo: dict[str, list[int]] = {}

    def tokens(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """Words as read, and their places in the text. Runs of single letters are read as the words they spell."""
        words: list[str] = []
        places: list[tuple[int, int]] = []
        spaced = [(m.start(), m.end()) for m in _SPACED.finditer(text)] if _SPACED.search(text) else []
        pos = 0
        for a, b in [*spaced, (len(text), len(text))]:
            for m in re.finditer(r"\S+", text[pos:a]):
                self._add(m.group(), pos + m.start(), words, places)
            if a < b:
                run = text[a:b]
                letters = "".join(c for c in run if c.isalpha())
                at = [a + i for i, c in enumerate(run) if c.isalpha()]
                k = 0
                for part in self.vocabulary.segment(letters):
                    words.append(part if part in self.vocabulary.words else "<oov>")
                    places.append((at[k], at[k + len(part) - 1] + 1))
                    k += len(part)
            pos = b
        return words, places

    def _add(self, raw: str, at: int, words: list[str], places: list[tuple[int, int]]) -> None:
        read = self.read(raw)
        if read != "<oov>" or not re.search(r"\w[\-/,;:.'’_]+\w", raw):
            words.append(read)
            places.append((at, at + len(raw)))
            return
        for m in re.finditer(r"[\w*@$]+", raw):
            words.append(self.read(m.group()))
            places.append((at + m.start(), at + m.end()))

    def read(self, raw: str) -> str:
        memo = self.read_memo
        got = memo.get(raw)
        if got is None:
            if len(memo) > 400_000:
                memo.clear()
            got = memo[raw] = self.vocabulary.read(raw)
        return got

    def _ids(self, text: str) -> list[int]:
        """Numbers of the words of ``tokens``."""
        if _SPACED.search(text):
            return self.table.ids(self.tokens(text)[0])
        memo, out = self.id_memo, []
        for raw in text.split():
            got = memo.get(raw)
            if got is None:
                if len(memo) > 400_000:
                    memo.clear()
                words: list[str] = []
                self._add(raw, 0, words, [])
                got = memo[raw] = self.table.ids(words)
            out += got
        return out

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every stretch of tokens tagged toxic; places are characters."""
        return next(self.all_spans([text]))

    def all_spans(self, texts: list[str]) -> Iterator[list[tuple[int, int, float]]]:
        """The spans of each text, many texts at once."""
        block: list[tuple[str, list[int]]] = []
        size = 0
        for text in texts:
            block.append((text, self._ids(text)))
            size += len(block[-1][1])
            if size >= self.BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[tuple[str, list[int]]]) -> Iterator[list[tuple[int, int, float]]]:
        for (text, _), p in zip(block, self.table.marginals([ids for _, ids in block])):
            out: list[tuple[int, int, float]] = []
            if len(p) and p.max() >= 0.5:
                places = self.tokens(text)[1]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (p >= 0.5).astype(np.int8), [0]))))
                for k, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    out.append((places[k][0], places[j - 1][1], float(p[k:j].mean())))
            yield out


# ---- learning from labelled documents --------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?!\s)[^.!?\n]+)*")


def _parts(text: str) -> list[str]:
    """The sentences and lines of a text."""
    return [p for p in _SENTENCE.findall(text) if p.strip()]


def _grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a}|{b}" for a, b in zip(words, words[1:]))]


class Evidence:
    """How much each word and pair of neighbouring words speaks for the tag, learnt from documents that carry a label or none.

    Parts (sentences, lines) of documents labelled ordinary, or without label, count as ordinary; a part of a document labelled
    toxic is toxic with a probability that follows from what its words and pairs say. They say what the shares of the
    *other* parts that hold them say, so that a part can't speak for itself. Labels may be wrong: a document labelled toxic
    needn't have a toxic part.
    """

    PRIOR = -2.5  # that a part of a document labelled toxic is toxic (log odds)
    STRENGTH = 2.0  # weight of the share of toxic parts where a word is rare

    def __init__(self, parts: list[list[str]], kinds: list[int | None], first: list[float], rounds: int) -> None:
        self.index: dict[str, int] = {}
        rows = [sorted({self.index.setdefault(g, len(self.index)) for g in _grams(w)}) for w in parts]
        flat = np.fromiter((i for r in rows for i in r), np.int64, sum(map(len, rows)))
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        seeds = np.array(first)
        said = np.log(np.clip(seeds, 1e-6, 1 - 1e-6) / (1 - np.clip(seeds, 1e-6, 1 - 1e-6)))  # of the first field
        labelled = np.array([k == 1 for k in kinds])
        # Parts without label that the field is sure of count neither way.
        counted = np.array([k is not None for k in kinds]) | (seeds < 0.5)
        total = np.bincount(flat, counted[owner].astype(float), len(self.index))
        # First round: every part of a document labelled toxic counts, so a word says how often its documents are.
        share = labelled.astype(float)
        # What is independent of the label stands in documents labelled toxic as often as any part does.
        base = float(np.clip(labelled.mean(), 1e-3, 0.5))
        for _ in range(rounds):
            own = share[owner]
            says = self._odds(np.bincount(flat, own, len(self.index))[flat] - own, total[flat] - counted[owner], base)
            z = self.PRIOR + 0.7 * np.add.reduceat(says, starts) + np.clip(said, -1.0, 3.0)
            every = 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))
            share = np.where(labelled, every, 0.0)
        self.share = every  # of all parts, also of those that counted as ordinary
        self.says = self._odds(np.bincount(flat, share[owner], len(self.index)), total, base)

    def _odds(self, toxic: np.ndarray, total: np.ndarray, base: float) -> np.ndarray:
        p = np.clip((toxic + self.STRENGTH * base) / (total + self.STRENGTH), 1e-4, 1 - 1e-4)
        return np.clip(np.log(p / (1 - p)) - math.log(base / (1 - base)), -3.0, 3.0)

    def stretch(self, words: list[str]) -> tuple[int, int]:
        """The stretch of a part with the largest sum of what its words and pairs say."""
        get, says = self.index.get, self.says
        one = [float(says[get(w)]) for w in words]
        pair = [float(says[get(f"{a}|{b}")]) for a, b in zip(words, words[1:])]
        best, at, total, start = -1e9, (0, len(words)), 0.0, 0
        for i, x in enumerate(one):
            if total <= 0:
                total, start = 0.0, i
            else:
                x += pair[i - 1]
            total += x
            if total > best:
                best, at = total, (start, i + 1)
        return at


def refine(texts: list[tuple[str, int | None]], rounds: int = 8) -> tuple[Field, Vocabulary]:
    """The field and vocabulary after documents have been learnt from: (text, label) with 1 toxic, 0 ordinary, None unlabelled.

    Labels are given to documents, the field needs them for tokens. Expectation-maximization (``Evidence``) finds the parts
    that make documents toxic; within them the stretch with the largest sum of evidence gets the toxic tag. The field is
    then trained on these parts, on ordinary ones and on the module's sentences together.
    """
    first, known = seed_field()
    presence = Counter(w for t, _ in texts for w in set(_words(t)))
    common = {w for w, n in presence.items() if n >= 2 and w.isalpha() and len(w) <= 24}
    scorer = Scorer(first, Vocabulary(known.words, common - known.words))
    parts, kinds = [], []
    for text, kind in texts:
        for part in _parts(text):
            if words := scorer.tokens(part)[0]:
                parts.append(words)
                kinds.append(kind)
    rng = random.Random(11)
    data = _seed_data(rng)
    learnt: set[str] = set()
    if 1 in kinds:
        seeds = [float(p.max()) for p in scorer.table.marginals([scorer.table.ids(w) for w in parts])]
        evidence = Evidence(parts, kinds, seeds, rounds)
        ordinary = []
        for w, kind, s, seed in zip(parts, kinds, evidence.share, seeds):
            if s > (0.8 if kind == 1 else 0.98) and kind != 0:
                a, b = evidence.stretch(w)
                learnt.update(w[a:b])
                data.append((w, [0] * a + [1] * (b - a) + [0] * (len(w) - b)))
            elif s < (0.5 if kind == 0 else 0.2) and (kind == 0 or seed < 0.2):  # some labels are wrong
                ordinary.append((-s, w))
                if kind == 0 and seed > 0.2:  # what the first field is wrong about
                    data += [(w, [0] * len(w))] * 4
        # Ordinary parts: those nearest to the toxic ones, and as many others at random.
        order = sorted(range(len(ordinary)), key=lambda i: ordinary[i][0])
        n = 2 * len(data)
        chosen = order[:n] + [rng.randrange(len(ordinary)) for _ in range(2 * n if ordinary else 0)]
        data += [(ordinary[i][1], [0] * len(ordinary[i][1])) for i in chosen]
    out = Field()
    out.weights = dict(first.weights)
    out.bias, out.start, out.stay, out.change = first.bias, first.start, first.stay, first.change
    out.train(data, 3, 0.3, rng)
    # Words that speak neither way needn't be told apart from unknown ones.
    weight = lambda w: sum(abs(out.weights.get(k + w, 0.0)) for k in ("w=", "p=", "n="))
    return out, Vocabulary(known.words, {w for w in common if w in learnt or weight(w) > 0.05} - known.words)


def training_sample(documents: DataFrame, labels: DataFrame, bound: int = 3000, plain_bound: int = 1500) -> list[tuple[str, int | None]]:
    """At most ``bound`` labelled documents with the majority of their labels (ties and nulls left out) and at most
    ``plain_bound`` others without label, both chosen by a hash of the id; whole texts."""
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    chosen = votes.where("share <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    plain = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct().join(votes, "doc_id", "left_anti")
    plain = plain.orderBy(F.xxhash64("doc_id"), "doc_id").limit(plain_bound).withColumn("share", F.lit(None).cast("double"))
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen.union(plain)), "doc_id").groupBy("doc_id", "share").agg(F.max("text").alias("text")).collect()
    return [(r["text"], None if r["share"] is None else int(r["share"] > 0.5)) for r in sorted(rows, key=lambda r: r["doc_id"])]


def _pack(field: Field) -> dict:
    return {"weights": {k: v for k, v in field.weights.items() if abs(v) > 1e-3}, "set": (field.bias, field.start, field.stay, field.change)}


def _scorer(weights: dict, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.weights = weights["weights"]
        field.bias, field.start, field.stay, field.change = weights["set"]
        scorer = Scorer(field, Vocabulary(weights["words"], weights["learnt"]))
        for batch in batches:
            scores, flags, spans = [], [], []
            for every in scorer.all_spans(batch.column(2).to_pylist()):
                found = [s for s in every if s[2] >= 0.3]
                score = max((s[2] for s in found), default=0.0)
                scores.append(round(score, 6))
                flags.append(score >= threshold)
                spans.append([{"start": a, "end": b, "score": round(s, 6)} for a, b, s in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_()), pa.array(spans, kind)], ["doc_id", "source", "score", "flagged", "spans"])

    return run


def abuse_scores(documents: DataFrame, labels: DataFrame | None = None, threshold: float = 0.6, label_bound: int = 3000, plain_bound: int = 1500) -> DataFrame:
    """``doc_id, source, score, flagged, spans``: every document with its score and the character offsets of the spans.

    Defined results: null ids give no row; a null or empty text scores 0; a document delivered again counts once, by its
    higher score; texts are read whole; extra columns are ignored; an empty table gives an empty result. The field is fitted
    on at most ``label_bound`` labelled and ``plain_bound`` other documents besides the sentences above; every document is
    scored.
    """
    field, vocabulary = seed_field()
    if labels is not None:
        field, vocabulary = refine(training_sample(documents, labels, label_bound, plain_bound))
    weights = _pack(field) | {"words": vocabulary.words - vocabulary.learnt, "learnt": vocabulary.learnt}
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    scored = spread(rows).mapInArrow(_scorer(weights, threshold), "doc_id bigint, source string, score double, flagged boolean, spans array<struct<start:bigint,end:bigint,score:double>>")
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", "flagged", "source", "spans")).alias("s")).select("doc_id", "s.source", "s.score", "s.flagged", "s.spans")


def source_rates(scores: DataFrame) -> DataFrame:
    """``source, documents, flagged, rate, mean_score`` per source."""
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.count_if("flagged") / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
