"""Places of regular-expression matches, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let, running

SPAN = "array<struct<start:int,end:int,match:string>>"
SPAN_IN_CONTEXT = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, where: Column | None = None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as [start, end, match] in code points, end
    exclusive. The pattern must not match the empty string. Splitting at the
    pattern gives what lies between the matches, and running totals their places.
    Texts for which `where` is false are not searched. With `context`, also so many
    characters before a match and one after it."""
    pairs = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")),
        lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(x["match"], F.lit("")).alias("match")),
    )

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"])), F.lit(0))
        # The last characters of all that lies before a pair.
        tail = lambda x: F.right(x, F.lit(context))
        tails = running(F.transform(p, lambda x: tail(F.concat(x["gap"], x["match"]))), F.lit(""), lambda a, b: tail(F.concat(a, b)))
        found = F.slice(p, F.lit(1), F.size(p) - 1)  # the last gap has no match after it

        def spans(t: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(t["ends"], i) + F.length(x["gap"])
                out = [start.alias("start"), F.get(t["ends"], i + 1).alias("end"), x["match"].alias("match")]
                if context:
                    following = F.get(p, i + 1)
                    out.append(tail(F.concat(F.get(t["tails"], i), x["gap"])).alias("before"))
                    out.append(F.coalesce(F.nullif(F.left(following["gap"], F.lit(1)), F.lit("")), F.left(following["match"], F.lit(1))).alias("after"))
                return F.struct(*out)

            return F.transform(found, span)

        return let(F.struct(ends.alias("ends"), *([tails.alias("tails")] if context else [])), spans)

    none = F.array().cast(SPAN_IN_CONTEXT if context else SPAN)
    return F.when(text.isNotNull() & (F.lit(True) if where is None else where), let(pairs, placed)).otherwise(none)


def apart(spans: Column) -> Column:
    """The spans (structs with start, end and base) that are base or overlap no base span."""
    most = F.lit((1 << 31) - 1)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))))

    def kept(o: Column) -> Column:
        n = F.size(o)
        upto = running(F.transform(o, lambda x: F.when(x["s"]["base"], x["end"]).otherwise(0)), F.lit(0), F.greatest)
        after = F.transform(F.reverse(o), lambda x: F.when(x["s"]["base"], x["start"]).otherwise(most))
        limits = F.struct(upto.alias("upto"), running(after, most, F.least).alias("after"))

        def judged(limit: Column) -> Column:
            alone = lambda x, i: (F.get(limit["upto"], i) <= x["start"]) & (F.get(limit["after"], n - 1 - i) >= x["end"])
            return F.filter(o, lambda x, i: x["s"]["base"] | alone(x, i))

        return F.transform(let(limits, judged), lambda x: x["s"])

    return let(ordered, kept)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of structs (kind: number in `kinds`, start, end), sorted by
    start, then kind, joined by commas."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
