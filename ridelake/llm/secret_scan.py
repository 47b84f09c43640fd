"""Secret scans with DataFrame functions only: patterns, and entropy of sliding windows.

Spans are found by splitting the text at the matches of a pattern: the lengths of the pieces and
of the matches give every offset, so a pattern costs one pass, and two more where it occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of secrets, in the order in which their kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidate strings of the entropy scan, and the characters that they may hold.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes by rising width: a candidate belongs to the first that matches it whole.
#: Each asks for some window with at least this many bits a character; strings of letters or of
#: digits alone belong to none.
CLASSES = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("alphanumeric", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.7),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.9),
]
#: Candidates that look like secrets but are none.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|redacted|your[_-]?(key|token|secret|password)",
    r"(?i)^(sha256|sha384|sha512)-[A-Za-z0-9+/=]+$",
]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def spans_of(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (kind, begin, stop, value) of all leftmost matches that ``keep`` accepts."""
    pieces = F.transform(F.split(text, pattern), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(found: Column, sizes: Column) -> Column:
        state = F.aggregate(
            found,
            F.struct(
                F.lit(0).alias("at"),
                F.lit(0).alias("i"),
                F.array().cast("array<struct<begin:int,stop:int,value:string>>").alias("spans"),
            ),
            lambda s, m: F.struct(
                (s["at"] + F.get(sizes, s["i"]) + F.length(m)).alias("at"),
                (s["i"] + 1).alias("i"),
                F.when(
                    keep(m),
                    F.concat(
                        s["spans"],
                        F.array(
                            F.struct(
                                (s["at"] + F.get(sizes, s["i"])).alias("begin"),
                                (s["at"] + F.get(sizes, s["i"]) + F.length(m)).alias("stop"),
                                m.alias("value"),
                            )
                        ),
                    ),
                )
                .otherwise(s["spans"])
                .alias("spans"),
            ),
        )
        return F.transform(
            state["spans"],
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(KINDS.index(kind)).alias("rank"),
                x["begin"].alias("begin"),
                x["stop"].alias("stop"),
                x["value"].alias("value"),
            ),
        )

    found = let(matches, lambda m: let(pieces, lambda p: located(m, p)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:string,rank:int,begin:int,stop:int,value:string>>"


def highest_entropy(value: Column) -> Column:
    """Largest Shannon entropy, in bits a character, of all windows of a candidate string.

    The counts of the characters are carried from window to window: one comes in, one goes out,
    and the sum of ``c * log2(c)`` changes by these two.
    """
    size = len(ALPHABET)

    def weight(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))

    def scan(codes: Column) -> Column:
        head = F.slice(codes, 1, WINDOW)
        counts = F.transform(
            F.sequence(F.lit(1), F.lit(size)), lambda k: F.size(F.filter(head, lambda c: c == k))
        )
        start = let(
            counts,
            lambda n: let(
                F.aggregate(n, F.lit(0.0), lambda total, c: total + weight(c)),
                lambda total: F.struct(n.alias("counts"), total.alias("sum"), total.alias("least"), F.lit(0).alias("out")),
            ),
        )

        def slide(s: Column, incoming: Column) -> Column:
            outgoing = F.get(codes, s["out"])
            # The outgoing character is taken off before the incoming one is counted.
            a = F.get(s["counts"], outgoing - 1)
            b = F.get(s["counts"], incoming - 1)
            changed = (
                s["sum"] - weight(a) + weight(a - 1) - weight(b) + weight(b + 1)
            )
            total = F.when(outgoing == incoming, s["sum"]).otherwise(changed)
            moved = F.transform(
                s["counts"],
                lambda n, k: n + (k + 1 == incoming).cast("int") - (k + 1 == outgoing).cast("int"),
            )
            return F.struct(
                moved.alias("counts"),
                total.alias("sum"),
                F.least(s["least"], total).alias("least"),
                (s["out"] + 1).alias("out"),
            )

        rest = F.slice(codes, WINDOW + 1, F.greatest(F.size(codes) - WINDOW, F.lit(0)))
        least = F.aggregate(rest, start, slide)["least"]
        return F.lit(WINDOW).cast("double") - least

    bits = F.log2(F.lit(float(WINDOW)))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)
    # H = log2(W) - sum(c * log2(c)) / W; ``scan`` returns W - least sum.
    return bits - (F.lit(float(WINDOW)) - let(codes, scan)) / F.lit(float(WINDOW))


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of candidate strings with a window of high entropy for their character class."""

    def secret(value: Column) -> Column:
        limit = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            limit = F.when(value.rlike(pattern), F.lit(bits)).otherwise(limit)
        harmless = F.lit(False)
        for pattern in allowed:
            harmless = harmless | value.rlike(pattern)
        judged = let(limit, lambda bits: bits.isNotNull() & (highest_entropy(value) >= bits))
        return ~harmless & F.coalesce(judged, F.lit(False))

    return spans_of(text, CANDIDATE, "entropy", secret)


def find_secrets(docs: DataFrame, *, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Add ``secrets``: spans (kind, rank, begin, stop, value) by begin, then kind as listed.

    Offsets count code points, end exclusive. Pattern kinds are leftmost, non-overlapping
    matches, of which too short ones are dropped; ``allowed`` suppresses entropy spans only, and
    kinds may overlap. A null or empty text has no spans; all rows and other columns pass as
    they are, and a column named ``secrets`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    value = F.regexp_extract
    kinds = [
        spans_of(whole, ASSIGN, "assign", lambda m: F.length(value(m, ASSIGN, 1)) >= ASSIGN_VALUE),
        spans_of(whole, ACCESS, "access", lambda m: F.length(m) >= ACCESS_LENGTH),
        # Runs are matched whole, so asking for the length in the pattern drops the same ones.
        spans_of(whole, rf"[0-9a-f]{{{HEX_LENGTH},}}", "hex", lambda m: F.length(m) >= HEX_LENGTH),
        entropy_spans(whole, allowed),
    ]
    by_place = F.array_sort(
        F.concat(*kinds),
        lambda a, b: F.when(a["begin"] != b["begin"], a["begin"] - b["begin"]).otherwise(a["rank"] - b["rank"]),
    )
    return docs.withColumn("secrets", by_place)


def listed(secrets: Column) -> Column:
    """Spans as ``kind:begin:stop``, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """Text with every stretch under one or more spans replaced by ``mark``."""
    state = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.when(
            x["stop"] <= s["at"], s
        ).otherwise(
            F.struct(
                F.when(x["begin"] < s["at"], s["done"])
                .otherwise(F.concat(s["done"], F.substring(text, s["at"] + 1, x["begin"] - s["at"]), F.lit(mark)))
                .alias("done"),
                x["stop"].alias("at"),
            )
        ),
    )
    rest = let(state, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, rest).otherwise(text)
