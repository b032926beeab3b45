"""Secret scan: fixed patterns, and a randomness test battery with error control."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.shared import stored
from wardwatch.llm.vocabulary import release_memory

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
KINDS = ["assign", "access", "hex", "random"]

RUN = 20  # shortest candidate of the battery
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
HEX_BYTES = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
RUN_BYTES = bytes(49 if b < 128 and re.match(r"[A-Za-z0-9+/_=-]", chr(b)) else 48 for b in range(256))

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
COMMON = set("etaoinsrETAOINSR")  # two thirds of the letters of text, a third of an alphabet
# Half of the letter pairs of English, German, French and Spanish text, a ninth of all pairs.
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be "
    "ma si om ur el la ue qu os ei ie ge un au sc ck ai ke ta ca do em us ss et il no na ad da lo ac nc tr".split()
)
# encoding, narrow ones first: alphabet, and the shortest string on which its tests can tell text from chance
ENCODINGS = {
    "hex": (DIGITS + "abcdef", 24),
    "HEX": (DIGITS + "ABCDEF", 24),
    "lower": (LOWER, 20),
    "UPPER": (UPPER, 20),
    "letters": (UPPER + LOWER, 20),
    "base32": (UPPER + "234567", 20),
    "base36": (LOWER + DIGITS, 20),
    "BASE36": (UPPER + DIGITS, 20),
    "base38": (LOWER + DIGITS + "-_", 20),
    "BASE38": (UPPER + DIGITS + "-_", 20),
    "base64": (UPPER + LOWER + DIGITS + "+/", 20),
    "base64url": (UPPER + LOWER + DIGITS + "-_", 20),
}
BINS = 240  # p-values on a grid of BINS / 20 decades


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping in a kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"1" * 32 in raw.translate(HEX_BYTES):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, encoding, symbols) of long runs that could be encoded bytes.

    Runs are cut at base spans, whose rest stays, and at inner '='. Each part is a
    candidate, and so are its longest stretches without '-' and '_', without '+' and '/',
    and without all four: names and prefixes joined to a key do not hide it."""
    if b"1" * RUN not in text.encode("utf-8", "surrogatepass").translate(RUN_BYTES):
        return
    blocked = _united(taken)
    starts = [x for x, _ in blocked]
    for m in CANDIDATE.finditer(text):
        seen = set()
        for left, right in _outside(*m.span(), blocked, starts):
            for part in PART.finditer(text, left, right):
                for cut in STRETCHES:
                    for piece in cut.finditer(text, *part.span()):
                        a, b = piece.span()
                        if b - a < RUN or (a, b) in seen:
                            continue
                        seen.add((a, b))
                        name, token = encoding_of(piece[0])
                        if name and len(token) >= ENCODINGS[name][1]:
                            # padding belongs to the string
                            yield a, right if not text[b:right].strip("=") else b, name, token


PART = re.compile(r"[^=]+")
STRETCHES = [re.compile(r) for r in (r"[^=]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+", r"[A-Za-z0-9]+")]


def _united(taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The base spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((x, y) for _, x, y in taken):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _outside(a: int, b: int, blocked: list[tuple[int, int]], starts: list[int]) -> Iterator[tuple[int, int]]:
    """What the united base spans leave of a run."""
    for i in range(max(0, bisect_right(starts, a) - 1), len(blocked)):
        x, y = blocked[i]
        if x >= b:
            break
        if a < x:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def encoding_of(token: str) -> tuple[str | None, str]:
    """The narrowest alphabet that holds the token, and the symbols to test: hexadecimal
    digits in groups are tested without their separators. Numbers have none, and base64
    alphabets need both cases, as one case has narrower ones."""
    plain = token.replace("-", "").replace("_", "")
    for name in ("hex", "HEX"):
        if set(plain) <= set(ENCODINGS[name][0]) and set(plain) & set(DIGITS) and set(plain) - set(DIGITS):
            return name, plain
    symbols = set(token)
    if not symbols - set(DIGITS + "+/-_"):
        return None, token
    for name, (alphabet, _) in ENCODINGS.items():
        if symbols <= set(alphabet):
            mixed_case = symbols & set(LOWER) and symbols & set(UPPER)
            return (name if mixed_case or not name.startswith("base64") else None), token
    return None, token


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    c = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def _binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of ``k`` or more of ``n``; exact for short strings."""
    if n > 400:
        return _normal_tail((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def battery(token: str, name: str) -> tuple[float, ...]:
    """p-values of uniformity, runs and serial correlation for a random string, and of
    the numbers of common letters and of common letter pairs where the alphabet has them all.

    Uniformity: chi-squared over the alphabet, or over as many equal classes of it as
    leave five symbols each to expect (four at least). Runs: number of runs above and
    below the alphabet's middle. Serial: correlation of neighbours.
    """
    alphabet = ENCODINGS[name][0]
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in token], float)
    n, size = len(x), len(alphabet)
    classes = int(max(4, min(size, n // 5)))
    group = (x * classes // size).astype(int)
    share = np.bincount((np.arange(size) * classes // size), minlength=classes) / size
    uniform = _chi2_tail(float((((np.bincount(group, minlength=classes) - n * share) ** 2) / (n * share)).sum()), classes - 1)
    high = x >= size / 2
    up = int(high.sum())
    if 0 < up < n:
        mean = 1 + 2 * up * (n - up) / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _normal_tail(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    spread = float(d @ d)
    serial = 2 * _normal_tail(abs(float(d[1:] @ d[:-1]) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    common = sum(c in COMMON for c in alphabet)
    if common < 8:
        return uniform, runs, serial
    low = token.lower()
    pairs = [x + y for x, y in zip(low, low[1:], strict=False) if x in LOWER and y in LOWER]
    usual = _binomial_tail(sum(c in COMMON for c in token), n, common / size)
    return uniform, runs, serial, usual, _binomial_tail(sum(x in PAIRS for x in pairs), len(pairs), len(PAIRS) / 676) if pairs else 1.0


def combined(p: tuple[float, ...]) -> float:
    """Fisher's combination; its chi-squared has an even number of degrees of freedom."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    term, total = 1.0, 1.0
    for i in range(1, len(p)):
        term *= half / i
        total += term
    return min(1.0, math.exp(-half) * total)


def stratum(name: str, length: int) -> str:
    """Encoding and length class: candidates are compared with those of like power."""
    return f"{name}/{int(math.log2(length))}"


def p_bin(p: float) -> int:
    """Grid number of a p-value, 0 the largest; the grid's upper edge is never below p."""
    return min(BINS - 1, int(-20 * math.log10(max(p, 1e-300))))


def rejection_bins(counts: dict[str, dict[int, int]], alpha: float) -> dict[str, int]:
    """By stratum, the smallest grid number that the step-up procedure of Benjamini and
    Hochberg rejects at ``alpha`` (BINS: none). Ranks are counts of the whole corpus; a
    grid number stands for its upper edge, so control is kept."""
    out = {}
    for name, bins in counts.items():
        total, least, rank = sum(bins.values()), BINS, 0
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if 10 ** (-b / 20) <= alpha * rank / total:
                least = b
        out[name] = least
    return out


SPAN = "struct<kind:string,start:long,end:long>"
CANDIDATES = "array<struct<start:long,end:long,stratum:string,bin:int,p:double>>"
FOUND = f"doc_id long, base array<{SPAN}>, candidates {CANDIDATES}"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("bin", pa.int32()), ("p", pa.float64())])


def _found(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    more = []
    for a, b, name, token in candidates(text, base):
        p = combined(battery(token, name))
        more.append({"start": a, "end": b, "stratum": stratum(name, len(token)), "bin": p_bin(p), "p": p})
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], more


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) per row."""

    def rows(batches):
        release_memory()
        for batch in batches:
            found = [_found(t.as_py() or "") for t in batch.column("text")]
            base = pa.array([b for b, _ in found], pa.list_(_ARROW_SPAN))
            more = pa.array([c for _, c in found], pa.list_(_ARROW_CANDIDATE))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, more], names=["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, FOUND)


def rejections(found: DataFrame, alpha: float) -> dict[str, int]:
    """``rejection_bins`` of all candidates: counted by stratum and grid number over the
    whole corpus, a table of fixed size."""
    cells = found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count()
    counts: dict[str, dict[int, int]] = {}
    for name, b, n in cells.collect():  # encodings x lengths x BINS rows at most
        counts.setdefault(name, {})[b] = n
    return rejection_bins(counts, alpha)


def _accepted(more: list[dict], least: dict[str, int]) -> list[tuple[int, int]]:
    """The candidates not rejected as ordinary strings, without those inside a longer one:
    in order of start, longer ones first, such a one ends no later than one before it."""
    passed = sorted(((c["start"], c["end"]) for c in more if c["bin"] < least[c["stratum"]]), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in passed:
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


def scan(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """One row per document: counts, the digest of the base spans, and all spans: base
    spans and the candidates that the error control does not reject. Per stratum, a share
    of ``alpha`` at most of what is *rejected as ordinary* is expected to be random
    strings; what share of the reported ones is ordinary is not controlled.

    Null and empty texts have none. Repeated rows are scanned each, and count each in
    the error control; other columns are ignored; an empty table gives no row. The work is
    linear in the length of a text but for the ordering of its spans.
    """
    found = stored(find(docs), "secrets")
    least = rejections(found, alpha)

    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, base, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "candidates")), strict=True):
                spans = [(s["start"], s["end"], s["kind"]) for s in base]
                counts = Counter(kind for _, _, kind in spans)
                digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                every = _joined(spans + [(a, b, "random") for a, b in _accepted(more, least)])
                out.append({"doc_id": doc_id, **{f"n_{k}": counts[k] for k in KINDS[:3]}, "base_sha256": digest, "spans": every})
            yield pa.RecordBatch.from_pylist(out, _ARROW_SCAN)

    return found.mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


_ARROW_SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def redacted(docs: DataFrame, alpha: float = 0.01, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; n_chars, where there is
    such a column, follows the text. A first pass gathers the error control's counts, a
    second one rewrites, so texts are neither stored nor shuffled. Texts without a
    secret, null ones included, stay as they are."""
    least = rejections(stored(find(docs), "secrets"), alpha)

    def rows(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts, changed = batch.column("text").to_pylist(), False
            for i, text in enumerate(texts):
                base, more = _found(text or "")
                spans = [(s["start"], s["end"]) for s in base] + _accepted(more, least)
                if spans:
                    texts[i], changed = _without(text, sorted(spans), mark), True
            if changed:
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    given = docs.withColumn("text", F.col("text").cast("string"))
    clean = given.mapInArrow(rows, given.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        same = F.col("n_chars").isNull() | F.col("text").isNull()
        clean = clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return clean


def _without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """Spans that overlap are replaced together."""
    parts, at = [], 0
    for a, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])
