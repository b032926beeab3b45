"""Text renderings with the reference rounding (exact binary value, half to even)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """Fixed-point text. ``format_string`` rounds the shortest decimal half up, which
    differs on values such as 0.285; the pattern form rounds the exact value."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def exact_round(x: Column, places: int) -> Column:
    return fixed(x, places).cast("double")


def _folding() -> tuple[str, str, str]:
    """(letters that fold, what they fold to, combining marks), by decomposition: every
    character whose compatible decomposition is one base character and marks. Forms that
    become several characters stay as they are."""
    letters, plain, marks = [], [], []
    for code in [*range(0x80, 0x3000), *range(0xFE20, 0xFE30)]:
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(d for d in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(d))
        if len(base) == 1 and base != c.lower():
            letters.append(c.lower() if len(c.lower()) == 1 else c)
            plain.append(base)
    return "".join(letters), "".join(plain), "".join(marks)


LETTERS, PLAIN, MARKS = _folding()
def _ranges(chars: str) -> str:
    """A character class in as few ranges as possible."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


MARK = _ranges(MARKS)
MAYBE_MARKED = r"[\x{300}-\x{2fff}\x{fe20}-\x{fe2f}]"  # quick to rule out for most texts
OTHER = r"[^\x00-\x7F]"


def normalize(s: Column) -> Column:
    """Lower case, accents folded and combining marks left out. Each other character
    stays one character, so ``fold_runs`` leads from folded offsets back to the text."""
    low = F.lower(F.translate(s, "\u0130", "i"))  # the one letter whose lower form is two characters
    return F.when(s.rlike(OTHER), F.translate(low, LETTERS + MARKS, PLAIN)).otherwise(F.lower(s))


def fold_runs(s: Column) -> Column:
    """Array of (q, n): n marks were left out behind the first q folded characters. Empty
    for almost every text."""
    ends = F.transform(F.split(s, MARK + "+", -1), lambda p: F.length(p))
    sizes = F.transform(F.regexp_extract_all(s, F.lit(f"({MARK}+)"), F.lit(1)), lambda m: F.length(m))
    kind = "struct<at:int,runs:array<struct<q:int,n:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<q:int,n:int>>").alias("runs")).cast(kind)

    def step(acc: Column, run: Column) -> Column:
        at = acc["at"] + run["0"]
        return F.struct(at.alias("at"), F.concat(acc["runs"], F.array(F.struct(at.alias("q"), run["1"].alias("n")))).alias("runs")).cast(kind)

    runs = F.aggregate(F.arrays_zip(F.slice(ends, F.lit(1), F.size(sizes)).alias("0"), sizes.alias("1")), start, step, lambda acc: acc["runs"])
    return F.when(s.rlike(MAYBE_MARKED) & s.rlike(MARK), runs).otherwise(F.array().cast("array<struct<q:int,n:int>>"))


def original_offset(p: Column, runs: Column) -> Column:
    """Where folded offset ``p`` lies in the text: behind all marks of the characters before."""
    return p + F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.when(r["q"] <= p, r["n"]).otherwise(0))


def replace_chars(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def capitalized(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
