"""Secret scan with built-in functions only.

Fixed patterns give the base spans.  The method's own spans are candidate
strings in which some window of ``WINDOW`` characters has a Shannon entropy
above the limit of the window's character class.  Entropy and class slide by
incremental counts: each step changes the counts of the entering and the leaving
character, the sum of ``c log2 c`` and the numbers of lower-case letters,
capitals, digits, hexadecimal letters and signs by their differences.  The
allow-list clears whole candidates, and windows that touch a placeholder; base
spans stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import hidden, quoted

#: A private-use character marks matches; where a text has it, another of the same width stands in.
MARK, OTHER = "\ue000", "\ue001"
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"  # the whole runs of 32 or more
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Bits a character that a window must pass, by class.  20 characters hold log2(20) = 4.32 at most; random windows
#: average 3.4 (hexadecimal), 3.9 (letters of one case and digits), 4.0 (letters of both cases), 4.1 (both and digits).
#: Classes without one of these, such as digits alone, plain words or words and signs, have no limit and are never secrets.
LIMITS = {"hex": 3.0, "lower": 3.6, "upper": 3.6, "mixed": 3.8, "letters": 4.05}
#: Least letters, and digits, of a window of the classes lower and upper; least letters of each case in one of letters only.
LEAST, LEAST_CASE = 3, 4
#: Never secrets as a whole: UUIDs, and paths of plain words, in which a capital follows a small letter fewer than
#: ``HUMPS`` times (no group repeats in the pattern: it would go as deep as the candidate is long).
ALLOW = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
WORDS, HUMP, HUMPS = "^[A-Za-z][A-Za-z/_=-]*[A-Za-z]$", "[a-z][A-Z]", 4
#: Placeholders, runs of the alphabet and of digits: no window that touches one counts.
PLACEHOLDER = "(?i:example|placeholder|changeme|redacted|your[_-]|abcdefghij)|0123456789"
BLOCK = 512


def _pieces(text: Column, pattern: str) -> Column:
    """The text between matches (even places) and the matches (odd places)."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _located(pieces: Column, kind: int) -> Column:
    """Matches with their code-point spans; arrays grow in blocks, so many matches stay linear."""
    row = "array<struct<start:int,kind:int,end:int,value:string>>"

    def one(state: Column, piece: Column) -> Column:
        end = state["pos"] + F.length(piece)
        found = F.struct(state["pos"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("pos"), (~state["odd"]).alias("odd"), F.when(state["odd"], F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    def start(pos: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(False).alias("odd"), F.array().cast(row).alias("out"))

    def block(state: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(pieces, at, F.lit(BLOCK)), start(state["pos"]), one)
        return F.struct(inner["pos"].alias("pos"), F.concat(state["outs"], F.array(inner["out"])).alias("outs"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{row}>").alias("outs"))
    # blocks start at even places, so an even BLOCK keeps text and matches alternating
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), init, block)["outs"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def _limit(s: Column) -> Column:
    """The limit of a window with these class counts; null without one."""
    lower, upper, digit, sign = (s[c] for c in ("lower", "upper", "digit", "sign"))
    pure = (sign == 0) & (digit > 0)
    hexes = ((upper == 0) & (lower > 0) & (lower == s["hexlower"])) | ((lower == 0) & (upper > 0) & (upper == s["hexupper"]))
    return (
        F.when(s["gap"] > 0, F.lit(None).cast("double"))
        .when(pure & hexes, LIMITS["hex"])
        .when(pure & (digit >= LEAST) & (upper == 0) & (lower >= LEAST), LIMITS["lower"])
        .when(pure & (digit >= LEAST) & (lower == 0) & (upper >= LEAST), LIMITS["upper"])
        .when((lower > 0) & (upper > 0) & (digit > 0), LIMITS["mixed"])
        .when((digit == 0) & (sign == 0) & (lower >= LEAST_CASE) & (upper >= LEAST_CASE), LIMITS["letters"])
    )


#: Places in ALPHABET of each class that is counted; a gap stands after the alphabet.
_CLASSES = {"upper": (0, 26), "lower": (26, 52), "digit": (52, 62), "sign": (62, 67), "hexupper": (0, 6), "hexlower": (26, 32), "gap": (67, 68)}


def excess(value: Column) -> Column:
    """By how much the entropy of any window of a candidate passes its class's limit at most; -1 if none has a limit."""
    value = F.regexp_replace(value, PLACEHOLDER, " ")
    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET + " ")) - 1)
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))

    def step(state: Column, i: Column) -> Column:
        codes_ = state["codes"]
        enter = F.get(codes_, i)
        full = i >= WINDOW
        leave = F.when(full, F.get(codes_, i - WINDOW)).otherwise(F.lit(-1))
        c_in, c_out = F.get(state["counts"], enter), F.get(state["counts"], F.greatest(leave, F.lit(0)))
        counts = F.transform(state["counts"], lambda c, j: c + (j == enter).cast("int") - (j == leave).cast("int"))
        change = F.get(table, c_in + 1) - F.get(table, c_in) + F.when(full, F.get(table, F.greatest(c_out - 1, F.lit(0))) - F.get(table, c_out)).otherwise(0.0)
        s = state["s"] + F.when(enter == leave, 0.0).otherwise(change)
        held = {k: state[k] + enter.between(a, b - 1).cast("int") - leave.between(a, b - 1).cast("int") for k, (a, b) in _CLASSES.items()}
        over = F.coalesce(F.lit(math.log2(WINDOW)) - s / WINDOW - _limit(held), F.lit(-1.0))
        best = F.when(i >= WINDOW - 1, F.greatest(state["best"], over)).otherwise(state["best"])
        return F.struct(codes_.alias("codes"), counts.alias("counts"), s.alias("s"), best.alias("best"), *(c.alias(k) for k, c in held.items()))

    init = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"), *(F.lit(0).alias(k) for k in _CLASSES))
    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), init, step)["best"]


def _high(value: Column) -> Column:
    """Whether some window of a candidate passes its limit and the allow-list does not clear it."""
    plain = value.rlike(WORDS) & (F.regexp_count(value, F.lit(HUMP)) < HUMPS)
    return F.when(value.rlike(ALLOW) | plain, F.lit(False)).otherwise(excess(value) > 0)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_secrets(docs: DataFrame, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """``docs`` with ``<prefix>assign, access, hex, entropy``: sorted arrays of spans.

    A span is ``(start, kind, end, value)``, in code points with an exclusive
    end.  Null and empty texts have none; very long texts are scanned whole.  One
    row in, one row out, so repeated rows and an empty table stay as they are;
    nothing is shuffled.  The default prefix is one that no column has.
    """
    p = hidden(docs.columns) if prefix is None else prefix
    t = f"{p}text"
    out = docs.withColumn(t, F.replace(F.coalesce(quoted(text_col).cast("string"), F.lit("")), F.lit(MARK), F.lit(OTHER)))
    text = F.col(t)

    def spans(kind: int, pattern: str, guard: Column) -> Column:
        return F.when(guard, _located(_pieces(text, pattern), kind)).otherwise(_none())

    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    out = out.withColumns({
        f"{p}0": spans(0, ASSIGN, text.rlike(KEYWORDS)),
        f"{p}1": spans(1, ACCESS, F.contains(text, F.lit("AKIA"))),
        f"{p}2": spans(2, HEX, text.rlike("[0-9a-f]{32}")),
        f"{p}3": spans(3, CANDIDATE, text.rlike(CANDIDATE)),
    })
    out = out.withColumns({
        f"{p}0": F.filter(f"{p}0", lambda s: F.length(value(s)) >= 8),
        f"{p}1": F.filter(f"{p}1", lambda s: F.length(s["value"]) >= 16),
        f"{p}3": F.filter(f"{p}3", lambda s: _high(s["value"])),
    })
    return out.withColumnsRenamed({f"{p}{i}": f"{p}{k}" for i, k in enumerate(KINDS)}).drop(t)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans, the digest of their list, and the list of all spans.

    Null and empty texts have none, and the digest of an empty list.  Each row of
    repeated ones comes back, an empty table gives no rows, other columns are not
    read and may have any name.
    """
    p = "__s_"
    found = find_secrets(docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__t")), "__t", p)
    base = F.array_sort(F.concat(*(F.col(p + k) for k in KINDS[:3])))
    every = F.array_sort(F.concat(*(F.col(p + k) for k in KINDS)))
    sizes = [F.size(p + k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(F.col("__id").alias(id_col), *sizes, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of secret spans replaced by ``mask``; texts without any, null ones too, stay as they are.

    Rows, columns and their names stay; ``length_col``, if there, follows the text.
    """
    p = hidden(docs.columns)
    found = find_secrets(docs, text_col, p).withColumn(p + "all", F.array_sort(F.concat(*(F.col(p + k) for k in KINDS))))
    text = quoted(text_col).cast("string")

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["pos"]
        add = F.concat(F.substring(text, state["pos"] + 1, s["start"] - state["pos"]), F.lit(mask))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(state["out"], F.array(add))).otherwise(state["out"]).alias("out"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    found = found.withColumn(p + "cut", F.when(F.size(p + "all") > 0, F.aggregate(p + "all", init, step)))
    rest = F.substring(text, F.col(p + "cut.pos") + 1, F.length(text))
    new = F.when(F.size(p + "all") > 0, F.concat(F.array_join(p + "cut.out", ""), rest)).otherwise(text)
    changes = {text_col: new}
    if length_col and length_col in docs.columns:
        changes[length_col] = F.when(F.size(p + "all") > 0, F.length(new).cast(docs.schema[length_col].dataType)).otherwise(quoted(length_col))
    return found.select(*(changes[c].alias(c) if c in changes else quoted(c) for c in docs.columns))
