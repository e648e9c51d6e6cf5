"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only built-in functions, one pass per row, no shuffle. The positions of the matches of a pattern follow from the
lengths of the matches and of the gaps between them (``regexp_extract_all`` and ``split`` with the same pattern). The
patterns are written with possessive repeats and a guard in front, which change no match but keep the work linear on
very long runs; a match may start after a guard character only where the last match ended.

Defined cases: a null or empty text has no spans; matches that fail their check are dropped without another try; spans
of different kinds may overlap, in the mask they merge; rows that repeat are searched each by itself; an empty table
gives an empty result; other columns are kept by ``mask`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
MIN_SCORE = 0.5
BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``valid`` confirms from the match and the characters before and after it ("" at the ends).

    ``hint`` is a plain string that every match holds.
    """

    name: str
    pattern: str
    valid: Callable[[Column, Column, Column], Column] | None
    context: str
    score: float
    base: bool = True
    hint: str | None = None


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def worth(back: Column) -> Column:
        digit = F.substring(number, F.negative(back), F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(back % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda sum_, back: sum_ + worth(back))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (two letters, two digits, letters and digits) leaves 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, at: Column) -> Column:
        char = F.substring(turned, at, F.lit(1))
        number = F.when(char.between("0", "9"), F.ascii(char) - F.lit(48)).otherwise(F.ascii(char) - F.lit(55))
        return ((rest * F.when(number > 9, F.lit(100)).otherwise(F.lit(10)) + number) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "mail|contact|write|reach", 0.8, hint="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m, before, after: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), "ip|address|host|server|from", 0.6, hint="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m, before, after: F.length(digits(m)).between(14, 19) & luhn(digits(m)), "card|visa|credit|pay|account", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, before, after: F.length(digits(m)).between(10, 15), "tel|phone|call|mobile|fax", 0.6, hint="+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", lambda m, before, after: ~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]") & mod97(m), "iban|bank|account|konto|compte|cuenta", 0.9, base=False),
    Kind("tel", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}", lambda m, before, after: ~after.rlike("[0-9]"), "tel|phone|call|mobile|fax", 0.6, base=False, hint="+"),
    Kind("pan", r"[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}", lambda m, before, after: ~before.rlike("[0-9]") & ~after.rlike("[0-9]") & luhn(digits(m)), "card|visa|credit|pay|account", 0.7, base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m, before, after: ~before.rlike("[0-9-]") & ~after.rlike("[0-9-]") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn|social|security|sozial|seguridad", 0.3, base=False),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, order, kind, end, score) of one kind, in code points, end exclusive, sorted by start."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    placed = F.aggregate(
        F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda state, x: F.when(x["match"].isNull(), state).otherwise(
            F.struct(
                (state["at"] + x["gap"] + F.length(x["match"])).alias("at"),
                F.array_append(
                    state["out"],
                    F.struct(
                        (state["at"] + x["gap"]).alias("start"),
                        (state["at"] + x["gap"] + F.length(x["match"])).alias("end"),
                        x["match"].alias("match"),
                    ),
                ).alias("out"),
            )
        ),
        lambda state: state["out"],
    )

    def confirmed(x: Column) -> Column:
        before = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise("")
        return kind.valid(x["match"], before, F.substring(text, x["end"] + 1, F.lit(1)))

    valid = F.filter(placed, confirmed) if kind.valid else placed

    def scored(x: Column) -> Column:
        before = F.least(x["start"], F.lit(CONTEXT_CHARS))
        near = F.lower(F.substring(text, x["start"] - before + 1, before))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"),
            x["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"),
        )

    out = F.transform(valid, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= MIN_SCORE)
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:double>>")
    worth = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]")
    return F.when(worth, out).otherwise(none)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the array ``into`` of (start, order, kind, end, score), by start and then order of the kinds.

    Spans beyond the base kinds count only where no base span covers them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(spans_of(text, kind, i) for i, kind in enumerate(kinds) if kind.base))
    more = F.concat(*(spans_of(text, kind, i) for i, kind in enumerate(kinds) if not kind.base))

    def joined(own: Column) -> Column:
        covered = lambda x: F.exists(own, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
        return F.array_sort(F.concat(own, F.filter(more, lambda x: ~covered(x))))

    return docs.withColumn(into, bind(base, joined))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per document: a count per base kind, the hash of the base spans and all spans."""
    found = find(docs.select("doc_id", "text"), kinds)
    base = [kind.name for kind in kinds if kind.base]
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long")
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    return found.select(
        "doc_id",
        *(count(name).alias(f"n_{name}") for name in base),
        F.sha2(written(own), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def mask(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; overlapping spans merge."""
    name = "_spans"
    while name in docs.columns:
        name += "_"
    found = find(docs, kinds, text_col, name)
    text, spans = F.col(text_col), F.col(name)
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] > x["start"]),
            F.array_append(
                F.slice(out, F.lit(1), F.size(out) - 1),
                F.struct(
                    F.element_at(out, -1)["start"].alias("start"),
                    F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"),
                    F.element_at(out, -1)["kind"].alias("kind"),
                ),
            ),
        ).otherwise(F.array_append(out, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
    )

    def pieces(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(rows, lambda x: x["end"]))
        parts = F.zip_with(
            F.slice(before, F.lit(1), F.size(rows)),
            rows,
            lambda at, x: F.concat(F.substring(text, at + 1, x["start"] - at), F.lit("<"), F.upper(x["kind"]), F.lit(">")),
        )
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(before, -1) + 1, F.length(text)))

    masked = F.when(F.size(spans) > 0, bind(merged, pieces)).otherwise(text)
    return found.withColumn(text_col, masked).drop(name)
