"""License scan: exact phrases, and short notices with a bounded number of errors."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices searched with errors: words, label, errors allowed.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license version 2 0", "apache", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person", "mit", 5),
    ("licensed under cc by", "cc-by", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 3),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
]


def _word_table() -> bytes:
    """A-Z to lower case; ASCII that is neither digit nor letter to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


WORD_TABLE = _word_table()


def normal_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class Scanner:
    """Exact phrases and fuzzy notices of one text at a time.

    A notice with k errors is split into k + 1 pieces: a place that differs by at most k
    edits holds one of them unchanged. One automaton finds all pieces; around each piece
    the bounded-error pattern is matched at its best, and must begin and end at words.
    """

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, int]]):
        self.phrases = [(f" {p} ".encode(), p.count(" ") + 1, label) for p, label in phrases.items()]
        self.notices = notices
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={k}}}(?= )") for n, _, k in notices]
        self.pieces = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for i, (notice, _, errors) in enumerate(notices):
            cuts = [round(len(notice) * j / (errors + 1)) for j in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((i, a, len(notice) - b))
        for seed, where in seeds.items():
            self.pieces.add_word(seed, where)
        self.pieces.make_automaton()

    def exact(self, line: bytes) -> list[tuple[int, int, str]]:
        """(first word, number of words, label) of every place, overlapping ones too."""
        found = []
        for phrase, size, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, size, label))
                at = line.find(phrase, at + 1)
        if not found:
            return []
        first = spaces_before([at for at, _, _ in found], np.frombuffer(line, np.uint8))
        return [(word, size, label) for word, (_, size, label) in zip(first, found, strict=True)]

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, errors, score) of the notices in a line of words; start and
        end count characters. Of overlapping spans of one notice the best stays."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.pieces.iter(line):
            for i, before, after in where:
                errors = self.notices[i][2]
                size = len(self.notices[i][0]) - before - after
                windows.setdefault(i, []).append((end + 1 - size - before - errors - 1, end + 1 + after + errors + 1))
        found = []
        for i, spans in windows.items():
            notice, label, _ = self.notices[i]
            merged = [list(min(spans))]
            for a, b in sorted(spans):
                if a > merged[-1][1]:
                    merged.append([a, b])
                merged[-1][1] = max(merged[-1][1], b)
            for a, b in merged:
                for m in self._best(i, line, max(0, a), b):
                    errors = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), label, errors, 1 - errors / len(notice)))
        return found

    def _best(self, i: int, line: str, a: int, b: int):
        """The best match of a stretch, then those left and right of it. A long stretch goes
        in steps of 64 notices, each read a notice and its errors further, so the work is
        linear; a step begins no earlier than the last match of the step before ends."""
        size, errors = len(self.notices[i][0]), self.notices[i][2]
        b = min(b, len(line))
        while a < b:
            after = a + 64 * size
            todo = [(a, min(b, after + size + errors + 2))]
            while todo:
                left, right = todo.pop()
                if right - left < size // 2:
                    continue
                m = self.patterns[i].search(line, left, right)
                if m and m.end() > m.start():
                    yield m
                    after = max(after, m.end() - 1)
                    todo += [(left, m.start() + 1), (m.end() - 1, right)]
            a = after


def spaces_before(places: list[int], codes: np.ndarray) -> list[int]:
    """Number of spaces in front of each place of a line given as character codes."""
    return np.searchsorted(np.flatnonzero(codes == 32), places).tolist()


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return Scanner(PHRASES, NOTICES)


SPAN = "struct<start:long,end:long,label:string,errors:int,score:double>"
SCAN = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, exact places, labels and fuzzy spans.

    ``spans`` are the fuzzy notices, start and end in words (end exclusive). ``score`` is
    1 with an exact place, else the best span's 1 - errors / length, else 0. Null and
    empty texts have no words and empty labels. Repeated rows are scanned each; other
    columns are ignored; an empty table gives no row.
    """

    def rows(batches):
        scanner = default_scanner()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = normal_words(text.as_py())
                line = b" " + b" ".join(words) + b" "
                exact = scanner.exact(line)
                shown = line.decode("utf-8", "surrogatepass")
                fuzzy = scanner.fuzzy(shown)
                fuzzy.sort()
                codes = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32) if fuzzy else np.empty(0, np.uint32)
                firsts = spaces_before([f[0] for f in fuzzy], codes)
                ends = spaces_before([f[1] for f in fuzzy], codes)
                spans = [
                    {"start": first - 1, "end": end, "label": label, "errors": errors, "score": score}
                    for (_, _, label, errors, score), first, end in zip(fuzzy, firsts, ends, strict=True)
                ]
                places = [p for p, _, _ in exact]
                base = {label for _, _, label in exact}
                out.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min(places, default=None),
                        "last_word": max(places, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {s["label"] for s in spans})),
                        "score": 1.0 if places else max((s["score"] for s in spans), default=0.0),
                        "spans": spans,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCAN)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int32()), ("score", pa.float64())]))),
    ]
)
