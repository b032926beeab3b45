"""Toxicity: misspelled lexicon terms by automata, told from quotation by their context.

The lexicon is learned: words that labelled toxic texts use in many different surroundings
and clean ones hardly use. Its terms form a trie. For a word of a text, a Levenshtein
automaton (also for swapped neighbours) runs along the trie and reports all terms within
one or two edits. Each hit gets a score from its term, its edits and a window of words
around it: marks of quotation and report lower it, second persons and further hits raise
it. A logistic model of the hits of a text gives the text's score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.shared import discard, stored

TOKEN = re.compile(r"[^\W_]+(?:[@$!*'’0-9]+[^\W_]+)*|[\"“”„«»‹›]", re.U)
REPEATED = re.compile(r"(.)\1{2}\1*")
QUOTES = frozenset("\"“”„«»‹›")
# Characters written for letters in disguised words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "'": "", "’": ""})
# Words that report or discuss what someone said, and second persons.
REPORTS = frozenset(
    "said says say saying wrote writes quoted quote quotes called calls calling word words term terms insult insults slur slurs "
    "dit disait écrit mot mots terme insulte sagte sagt schrieb wort begriff beleidigung dijo dice escribió palabra palabras término insulto".split()
)
SECOND = frozenset("you your yours you're youre u ur tu toi te ton ta tes vous votre du dich dir dein deine ihr euch tú ti usted vos".split())
STEM = "-"
N_FEATURES = 10
# Where training says nothing a feature keeps this weight: bias, term, one edit, two edits,
# stem, quoted, reported, second person, other hits near, capitals.
PRIOR = np.array([-1.0, 0.5, -1.0, -2.5, -0.5, -2.5, -1.5, 0.5, 0.5, 0.3])


def folded(word: str) -> str:
    """A word in its plain form: lower case, no accents, digits and signs that stand for
    letters replaced, letters repeated three times or more written once."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if not word.isalpha() and not word.isdigit():
        word = word.translate(LEET)
    return REPEATED.sub(r"\1", word) if REPEATED.search(word) else word


def edits_allowed(term: str) -> int:
    """None for stems and words of up to three letters, one up to seven, then two."""
    return 0 if len(term) < 4 or term.endswith(STEM) else 1 if len(term) < 8 else 2


class LexiconTrie:
    """A trie of terms: whole words, and stems, which end in ``STEM`` and stand for every
    word that begins so. Each node knows the most edits a term below it allows."""

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.edits: list[int] = [0]
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.accepts: list[list[tuple[str, int]]] = []
        self.moves: list[dict[str, int] | None] = []
        for term in sorted(set(terms)):
            plain, node = term.removesuffix(STEM), 0
            self.edits[0] = max(self.edits[0], edits_allowed(term))
            for c in plain:
                node = self._child(node, c)
                self.edits[node] = max(self.edits[node], edits_allowed(term))
            (self.word if term == plain else self.stem)[node] = term

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            for values, empty in ((self.children, {}), (self.word, None), (self.stem, None), (self.edits, 0)):
                values.append(empty)
        return self.children[node][c]

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving letters of a term out."""
        for node, e in sorted(states.items(), key=lambda x: x[1]):
            todo = [(node, e)]
            while todo:
                at, spent = todo.pop()
                for child in self.children[at].values():
                    if spent < self.edits[child] and states.get(child, spent + 2) > spent + 1:
                        states[child] = spent + 1
                        todo.append((child, spent + 1))
        return states

    def _state(self, states: dict[int, int], swaps: frozenset, stems: frozenset) -> int:
        """The number of a state of the automaton: fewest edits per node, halves of swapped
        pairs, and stems already read."""
        key = (frozenset(states.items()), swaps, stems)
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.states)
            words = [(t, e) for node, e in states.items() if (t := self.word[node]) is not None and e <= edits_allowed(t)]
            self.states.append((states, swaps, stems))
            self.accepts.append(sorted([*words, *((t, 0) for t in stems)]))
            self.moves.append({} if states or swaps else None)
        return found

    def _move(self, at: int, c: str) -> int:
        """The next state on letter ``c``: matched, changed, put in, or half of a swap."""
        states, swaps, stems = self.states[at]
        new: dict[int, int] = {}
        half = set()

        def reach(node: int, e: int):
            if e <= self.edits[node] and e < new.get(node, e + 1):
                new[node] = e

        for node, e in states.items():
            reach(node, e + 1)
            for letter, child in self.children[node].items():
                reach(child, e if letter == c else e + 1)
                after = self.children[child].get(c)
                if letter != c and after is not None and e < self.edits[after]:
                    half.add((after, letter, e + 1))
        for node, letter, e in swaps:
            if letter == c:
                reach(node, e)
        read = {t for node, e in new.items() if e == 0 and (t := self.stem[node]) is not None}
        return self._state(self._closed(new), frozenset(half), stems | read)

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of all terms within the edits allowed to them. An edit is a letter
        put in, left out or changed, or two neighbours swapped.

        The Levenshtein automata of all terms, laid over the trie, are read as one
        automaton, made deterministic state by state as words need it."""
        if not self.states or len(self.states) > 20_000:
            self.numbers, self.states, self.accepts, self.moves = {}, [], [], []
            self._state(self._closed({0: 0}), frozenset(), frozenset())
        at = 0
        for c in word:
            moves = self.moves[at]
            if moves is None:
                break  # no term is in reach any more
            to = moves.get(c)
            if to is None:
                to = moves[c] = self._move(at, c)
            at = to
        return self.accepts[at]


class Spellings(dict):
    """The nearest lexicon term of a word as written: (term number, edits) or None;
    remembered for up to ``limit`` words."""

    def __init__(self, trie: LexiconTrie, numbers: dict[str, int], ordinary: frozenset[str], limit: int = 200_000):
        super().__init__()
        self.trie, self.numbers, self.ordinary, self.limit = trie, numbers, ordinary, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        plain = folded(word)
        found = self.trie.near(plain)
        value = None
        if found:
            # fewest edits, whole words before stems, then the stronger term
            term, edits = min(found, key=lambda f: (f[1], f[0].endswith(STEM), self.numbers[f[0]]))
            if not edits or plain not in self.ordinary:
                value = (self.numbers[term], edits)
        self[word] = value
        return value


@dataclass
class Lexicon:
    """Learned terms, strongest first, with their log odds, and forms near them that are
    words of their own and no misspellings."""

    terms: list[str]
    odds: list[float]
    ordinary: frozenset[str] = frozenset()

    def spellings(self) -> Spellings:
        return Spellings(LexiconTrie(self.terms), {t: i for i, t in enumerate(self.terms)}, self.ordinary)


def hits_of(text: str, lexicon: Lexicon, spellings: Spellings, window: int = 8) -> tuple[np.ndarray, int]:
    """(features of each hit, number of words) of a whole text."""
    words = TOKEN.findall(text)
    found = [(i, hit) for i, hit in enumerate(map(spellings.__getitem__, words)) if hit is not None]
    out = np.zeros((len(found), N_FEATURES))
    if not found:
        return out, len(words)
    marks = np.fromiter((w in QUOTES for w in words), np.int64, len(words))
    before = np.concatenate([[0], np.cumsum(marks)])
    place = np.array([i for i, _ in found])
    near = np.searchsorted(place, place + window, "right") - np.searchsorted(place, place - window, "left") - 1
    for j, (i, (term, edits)) in enumerate(found):
        a, b = max(0, i - window), min(len(words), i + window + 1)
        around = [w.lower() for w in words[a:b]]
        quoted = before[i] - before[a] > 0 and before[b] - before[i + 1] > 0
        out[j] = (
            1.0,
            lexicon.odds[term],
            edits == 1,
            edits == 2,
            lexicon.terms[term].endswith(STEM),
            quoted,
            any(w in REPORTS for w in around),
            any(w in SECOND for w in around),
            min(near[j], 3),
            len(words[i]) > 3 and words[i].isupper(),
        )
    return out, len(words)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, strength: float, rounds: int = 60) -> np.ndarray:
    """Weights of greatest posterior under a normal prior, by damped Newton steps."""
    w = prior.copy()

    def loss(v):
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + strength / 2 * ((v - prior) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + strength * (w - prior)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    hit_weights: np.ndarray
    text_weights: np.ndarray

    def text_features(self, hits: np.ndarray, n_words: int) -> np.ndarray:
        """Bias, strongest hit, all hits together, their share of the words, and, for a text
        with hits, its length, as a long one has some by chance."""
        if not len(hits):
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        p = _sigmoid(hits @ self.hit_weights)
        return np.array([1.0, p.max(), np.log1p(p.sum()), min(10.0, 100 * p.sum() / max(n_words, 20)), np.log1p(n_words) / 5])

    def score(self, hits: np.ndarray, n_words: int) -> float:
        return float(_sigmoid(self.text_features(hits, n_words) @ self.text_weights))


def _prefixes(word: str) -> list[str]:
    """A word as a term, and the stems it begins with."""
    return [word, *(word[:i] + STEM for i in range(4, min(len(word), 11)))]


def term_counts(labelled: DataFrame, limit: int = 200_000) -> DataFrame:
    """(term, texts, uses, around, words) of the words and stems of a column of texts:
    texts that hold the term, its uses, and a 64-bit sketch of the words beside it. Tasks
    add up to ``limit`` terms before they are summed map-side; a null term counts all words."""

    def rows(batches):
        held: dict[str, list[int]] = {}
        words_seen = 0

        def flush():
            if held or words_seen:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None, *held], pa.string()),
                        *(pa.array([first, *(v[i] for v in held.values())], pa.int64()) for i, first in ((0, 0), (1, words_seen))),
                        pa.array(np.array([0, *(v[2] for v in held.values())], np.uint64).view(np.int64)),
                    ],
                    names=["term", "texts", "uses", "around"],
                )
                held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [folded(w) for w in TOKEN.findall(text) if w not in QUOTES]
                words_seen += len(words)
                met: dict[str, list[int]] = {}
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    if 3 <= len(w) <= 24:
                        cell = met.setdefault(w, [0, 0])
                        cell[0] += 1
                        cell[1] |= 1 << zlib.crc32(f"{before} {after}".encode("utf-8", "replace")) % 64
                seen: set[str] = set()
                for w, (uses, bits) in met.items():
                    for term in _prefixes(w):
                        cell = held.get(term)
                        if cell is None:
                            cell = held[term] = [0, 0, 0]
                        if term not in seen:
                            seen.add(term)
                            cell[0] += 1
                        cell[1] += uses
                        cell[2] |= bits
                if len(held) >= limit:
                    yield from flush()
                    words_seen = 0
        yield from flush()

    made = labelled.select("text").mapInArrow(rows, "term string, texts long, uses long, around long")
    return made.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("uses").alias("uses"), F.expr("bit_or(around)").alias("around"))


def learn_lexicon(labelled: DataFrame, least: int = 3) -> Lexicon:
    """Words and stems that mark labelled texts (text, toxic), one row per distinct text.

    A term's support is the number of toxic texts that hold it, at most the number of
    surroundings seen around it there, so copies do not make a term. Terms are kept when
    their likelihood ratio exceeds 2 ln V, V the terms tried, and they are used in toxic
    texts at four times the rate or more. A stem gives way to a longer term with nearly
    all its support, a term to a stem of it that is about as telling. Kept terms, which
    the labels of a bounded sample support, reach the driver.
    """
    sizes = dict(labelled.groupBy("toxic").count().collect())  # two rows
    n_toxic, n_clean = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    toxic = stored(term_counts(labelled.filter("toxic = 1")), "toxic-terms")
    clean = stored(term_counts(labelled.filter("toxic = 0")), "clean-terms")
    w_toxic, w_clean = ((t.filter("term is null").agg(F.sum("uses")).first()[0] or 0) for t in (toxic, clean))
    bits = F.expr("bit_count(around)").cast("double")
    kinds = F.when(bits > 60, float("inf")).otherwise(-64 * F.log(1 - bits / 64))
    support = F.least(F.col("texts").cast("double"), F.round(kinds))
    known = toxic.filter("term is not null").select("term", support.alias("s"), F.col("uses").alias("u")).filter(F.col("s") >= least)
    tried = max(2, known.count())
    c, v = F.coalesce("texts", F.lit(0)).cast("double"), F.coalesce("uses", F.lit(0)).cast("double")
    joined = known.join(clean.filter("term is not null").select("term", "texts", "uses"), "term", "left").select("term", "s", "u", c.alias("c"), v.alias("v"))
    share = (F.col("s") + F.col("c")) / max(1.0, n_toxic + n_clean)

    def part(k, n):
        held = F.when(k > 0, k * F.log(k / (share * n))).otherwise(0.0)
        rest = F.lit(n) - k
        return held + F.when(rest > 0, rest * F.log(rest / ((1 - share) * n))).otherwise(0.0)

    ratio = 2 * (part(F.col("s"), n_toxic) + part(F.col("c"), n_clean))
    odds = F.log((F.col("u") + 0.5) / float(w_toxic + 1)) - F.log((F.col("v") + 0.5) / float(w_clean + 1))
    strong = joined.select("term", "s", ratio.alias("g"), odds.alias("odds"))
    strong = {t: (s, o) for t, s, o in strong.filter((F.col("g") > 2 * float(np.log(tried))) & (F.col("odds") > float(np.log(4)))).select("term", "s", "odds").collect()}
    for used in (toxic, clean):
        discard(used)
    whole = dict(strong)
    for term, (s, _) in sorted(strong.items(), key=lambda x: len(x[0])):
        plain = term.removesuffix(STEM)
        for stem in [*_prefixes(plain)[1:], plain + STEM]:
            if stem != term and stem in whole and s >= 0.95 * strong[stem][0]:
                whole.pop(stem)
    kept = {}
    for term, (_, o) in sorted(whole.items(), key=lambda x: (len(x[0].removesuffix(STEM)), not x[0].endswith(STEM), x[0])):
        if all(stem == term or stem not in kept or kept[stem] < o - 0.7 for stem in _prefixes(term.removesuffix(STEM))[1:] + [term.removesuffix(STEM) + STEM]):
            kept[term] = o
    terms = sorted(kept, key=lambda t: (-kept[t], t))
    return Lexicon(terms, [kept[t] for t in terms])


def ordinary_forms(labelled: DataFrame, lexicon: Lexicon, least: int = 2) -> frozenset[str]:
    """Forms near a term, but not equal to one, that ``least`` clean texts hold and that are
    no rarer there than in toxic ones: other words, not misspellings. Few forms are near a
    term; only those reach the driver."""

    def near(batches):
        spellings = lexicon.spellings()
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forms = sorted({folded(w) for w in set(TOKEN.findall(text)) if (hit := spellings[w]) is not None and hit[1]})
                if forms:
                    yield pa.RecordBatch.from_pydict({"form": pa.array(forms), "toxic": pa.array([toxic] * len(forms), pa.int32())})

    met = labelled.select("text", "toxic").mapInArrow(near, "form string, toxic int").groupBy("form")
    counts = met.agg(F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t"))
    return frozenset(r[0] for r in counts.filter((F.col("c") >= least) & (F.col("c") >= F.col("t"))).collect())


def chosen_rows(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``max_rows`` distinct texts of each label, those of the
    smallest seeded text hashes, and how many rows each label has.

    Ids and hashes alone are joined and sorted; the chosen ones, a table of bounded size,
    then go to the documents, so texts are never shuffled.
    """
    key = [F.col("doc_id"), F.xxhash64("text", F.lit(seed)).alias("h")]
    met = stored(docs.filter("text is not null").select(*key).join(labels.select("doc_id", "toxic"), "doc_id"), "labelled-ids")
    counts = dict(met.groupBy("toxic").count().collect())  # two rows
    distinct = met.groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    parts = [distinct.filter(F.col("toxic") == t).orderBy("h").limit(max_rows) for t in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]), "chosen")
    rows = docs.filter("text is not null").select("text", *key).join(F.broadcast(chosen), ["doc_id", "h"])
    rows = stored(rows.groupBy("h", "toxic").agg(F.first("text").alias("text")).select("text", "toxic"), "labelled")
    for used in (met, chosen):
        discard(used)
    return rows, counts


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, seed: int = 11, window: int = 8) -> ToxicityModel:
    """Lexicon and both logistic models from at most ``max_rows`` distinct texts of
    ``docs`` (doc_id, text) for each of the ``labels`` (doc_id, toxic), one label an id. The
    driver sees hit features, never texts; rows weigh what their label has per chosen row."""
    rows, counts = chosen_rows(docs, labels, max_rows, seed)
    lexicon = learn_lexicon(rows)
    lexicon.ordinary = ordinary_forms(rows, lexicon) if lexicon.terms else frozenset()

    def features(batches):
        spellings = lexicon.spellings()
        for batch in batches:
            made = [hits_of(t, lexicon, spellings, window) for t in batch.column(0).to_pylist()]
            # a text gives its 64 strongest hits, so that the sample has a bound
            kept = [h[np.argsort(-(h @ PRIOR), kind="stable")[:64]] for h, _ in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for _, n in made], pa.int64()), pa.array([h.astype("<f4").tobytes() for h in kept], pa.binary())], names=["toxic", "n", "hits"]
            )

    taken = sorted(tuple(r) for r in rows.mapInArrow(features, "toxic int, n long, hits binary").collect())
    discard(rows)
    y = np.array([t for t, _, _ in taken], float)
    hits = [np.frombuffer(h, "<f4").astype(float).reshape(-1, N_FEATURES) for _, _, h in taken]
    start = np.array([-2.0, 2.0, 1.0, 0.1, 0.0])
    model = ToxicityModel(lexicon, PRIOR.copy(), start)
    if not len(y):
        return model
    weight = np.array([counts.get(t, 0) / max(1.0, float((y == t).sum())) for t in (0, 1)])[y.astype(int)]
    weight *= len(y) / weight.sum()
    owner = np.repeat(np.arange(len(y)), [len(h) for h in hits])
    if len(owner):
        share = weight / np.maximum(1, np.bincount(owner, minlength=len(y)))  # a text counts once
        model.hit_weights = _logistic(np.concatenate(hits), y[owner], share[owner], PRIOR, 1.0)
    x = np.stack([model.text_features(h, n) for h, (_, n, _) in zip(hits, taken, strict=True)])
    base = start.copy()
    base[0] = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    model.text_weights = _logistic(x, y, weight, base, 0.5)
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, window: int = 8) -> DataFrame:
    """(doc_id, score, predicted, n_hits) per row of ``docs``, from the whole text alone.

    Null and empty texts have no hits and get the score of such texts; repeated rows are
    scored each; a very long text costs its length; where a word is near several terms,
    fewest edits count, then the stronger term; other columns are ignored; an empty table
    gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms that labels support, and a few weights

    def rows(batches):
        m = shared.value
        spellings = m.lexicon.spellings()
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1):
                found, n = hits_of(text.as_py() or "", m.lexicon, spellings, window)
                scores.append(m.score(found, n))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.int64())],
                names=["doc_id", "score", "predicted", "n_hits"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(rows, "doc_id long, score double, predicted int, n_hits long")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; null is in no part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) per row of ``docs``; the model comes from
    the rows of ``labels`` (doc_id, toxic) that are not held out. Null ids and labels, and
    ids that are labelled both ways, teach nothing; without labels all scores are alike."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most and doc_id is not null").drop("most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_toxicity(texts, known.select("doc_id", F.col("toxic").cast("int").alias("toxic")), max_rows)
    return score(docs, model, threshold).withColumn("held_out", held_out())
