"""Licence scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A text is compared whole, by paragraph (lines up to an empty one) and by line. What none of these settles is searched for
stretches of any words in a row, over lines and paragraphs: a licence of several paragraphs, or a notice inside a longer
line. For each template the stretch is looked for in whose words the template's bigrams most outweigh others: runs of sums over the
text (``stretch``), so the work grows with its length however damaged its licences are. A stretch gives way to a better one that
overlaps it. Text is lower-cased and everything but letters and digits becomes a space. A unit with n different bigrams can
reach a Dice coefficient of d with a template of m bigrams only if n lies between d / (2 - d) * m and
(2 - d) / d * m: these bounds prune templates, and units whose word count no template admits are never cut into bigrams. Texts without any of some word beginnings (``stems_of``)
can meet no template and are left at once.
Templates are a constant of the plan (a parameter; some tens of texts), so nothing is shuffled.

Defined results: null, empty and one-word texts match nothing. Every row of the input gives a row, repeated rows
included. Of equally good templates of one licence the first counts. Columns beside the text are passed through by
``scan``; names that begin with an underscore are its own.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import let, table, text_of, up_to
from vigilake.llm.licence_templates import BODIES, TEMPLATES

DICE = 0.8
#: Templates whose marks share a number; rounds in which a stretch's coefficient is raised.
MARKS, ROUNDS = 60, 3
#: Words that any text holds: no stems.
COMMON = set("a an and are by for in is of or the this to under other which these those there their either means such".split())


def normalised(text: str) -> list[str]:
    """Words of a template."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def hashed(bigram: str) -> int:
    """As Spark's xxhash64."""
    value = xxhash.xxh64_intdigest(bigram.encode(), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


def template_column(templates: list[tuple[str, str]], dice: float) -> tuple[Column, int, float]:
    """Constant array of (licence, n, least, most, bigrams); the smallest and largest number of bigrams admitted."""
    rows, bounds = [], []
    for name, text in templates:
        pairs = bigrams_of(text)
        least, most = dice / (2 - dice) * len(pairs), (2 - dice) / dice * len(pairs)
        bounds.append((least, most))
        rows.append({"licence": name, "n": len(pairs), "places": len(normalised(text)) - 1, "least": least, "most": most, "bigrams": [hashed(p) for p in pairs]})
    schema = "array<struct<licence:string,n:int,places:int,least:double,most:double,bigrams:array<bigint>>>"
    return F.from_json(F.lit(json.dumps(rows)), schema), min(int(b[0]) for b in bounds), max(b[1] for b in bounds)


@lru_cache(maxsize=8)
def stems_of(templates: tuple[tuple[str, str], ...], dice: float) -> list[str] | None:
    """Beginnings of words of which every text that meets a template holds one; None where there are none.

    What meets a template of m bigrams holds dice / (2 - dice) * m of them, so it cannot miss all those with a stem once
    the ones without are fewer.
    """
    open_ = [(len(p), set(p)) for _, text in templates if (p := bigrams_of(text))]
    stems: list[str] = []
    while open_ := [(m, left) for m, left in open_ if len(left) >= dice / (2 - dice) * m]:
        # Longer words are rarer; short ones where a template has no others left.
        gain = next((g for short in (5, 2) if (g := Counter(
            stem for _, left in open_ for pair in left for stem in {w[:6] for w in pair.split() if len(w) >= short and w.isascii() and w not in COMMON}))), None)
        if not gain:
            return None
        stems.append(max(sorted(gain), key=gain.get))
        open_ = [(m, {p for p in left if not any(w.startswith(stems[-1]) for w in p.split())}) for m, left in open_]
    return stems


def cleaned(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\n]+", " ")


def one_line(unit: Column) -> Column:
    return F.trim(F.translate(unit, "\n", " "))


def units(clean: Column) -> Column:
    """Different lines, paragraphs and the whole of a cleaned text."""
    return F.array_distinct(F.transform(F.concat(F.split(clean, "\n"), F.split(clean, r"\n *\n"), F.array(clean)), one_line))


def bigram_hashes(words: Column) -> Column:
    """Of every word and the next one, in order."""
    return F.transform(up_to(F.size(words) - 1), lambda i: F.xxhash64(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def words_in(unit: Column) -> Column:
    return F.array_remove(F.split(unit, " "), "")


def cuckoo_table(values: list[int]) -> tuple[list[int | None], int]:
    """The numbers in a table of 2^bits places, each at one of its two places (``places_of``)."""
    bits = max(4, (2 * len(values)).bit_length())
    while True:
        table: list[int | None] = [None] * (1 << bits)
        if all(_placed(table, v, bits) for v in values):
            return table, bits
        bits += 1


def places_of(value: int, bits: int) -> tuple[int, int]:
    return value & (1 << bits) - 1, value >> 32 & (1 << bits) - 1


def _placed(table: list[int | None], value: int, bits: int) -> bool:
    at = places_of(value, bits)[0]
    for _ in range(500):
        value, table[at] = table[at], value
        if value is None:
            return True
        first, second = places_of(value, bits)
        at = second if at == first else first
    return False


def marks(hashes: Column, templates: list[tuple[str, str]]) -> list[Column]:
    """Per 60 templates: for every hash the templates that hold it, one bit each; two looks into a constant table, however many bigrams there are."""
    held: dict[int, int] = {}
    for t, (_, text) in enumerate(templates):
        for pair in bigrams_of(text):
            held[hashed(pair)] = held.get(hashed(pair), 0) | 1 << t
    table, bits = cuckoo_table(sorted(held))
    keys = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    low = F.lit((1 << bits) - 1)

    def looked_up(first: int) -> Column:
        masks = F.from_json(F.lit(json.dumps([0 if v is None else held[v] >> first & (1 << MARKS) - 1 for v in table])), "array<bigint>")

        def look(h: Column) -> Column:
            a, b = h.bitwiseAND(low).cast("int"), F.shiftright(h, 32).bitwiseAND(low).cast("int")
            return F.when(F.get(keys, a) == h, F.get(masks, a)).when(F.get(keys, b) == h, F.get(masks, b)).otherwise(F.lit(0).cast("bigint"))

        return F.transform(hashes, look)

    return [looked_up(first) for first in range(0, len(templates), MARKS)]


def stretch(places: Column, dice: Column, most: Column) -> Column:
    """(sum, a, b): the places a to b where 2 - dice for every bigram of the template, less dice for every other one, sum up most.

    ``places`` are those with bigrams of the template, in order; the best stretch begins and ends at one. A stretch ends at
    ``most`` of them: what follows is another copy.
    """
    kind = "struct<at:int,sum:double,from:int,hits:int,best:struct<sum:double,a:int,b:int>>"
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("hits"), none.alias("best")).cast(kind)

    # A step is taken at every such place for every template, and its columns are worked out wherever they stand.
    def step(acc: Column, place: Column) -> Column:
        def grown(left: Column) -> Column:
            on = (left > 0) & (acc["hits"] < most)
            total = F.when(on, left).otherwise(0.0) + (2.0 - dice)
            begin = F.when(on, acc["from"]).otherwise(place)
            return F.struct(
                (place + 1).alias("at"), total.alias("sum"), begin.alias("from"), (F.when(on, acc["hits"]).otherwise(0) + 1).alias("hits"),
                F.when(total > acc["best"]["sum"], F.struct(total.alias("sum"), begin.alias("a"), place.alias("b"))).otherwise(acc["best"]).alias("best"))

        # What the places between leave of the sum; once it is used up a new stretch begins.
        between = F.when(place > acc["at"], F.sequence(acc["at"], place - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(between, acc["sum"], lambda left, _: left - dice, grown)

    return F.aggregate(places, start, step, lambda acc: acc["best"])


def windows(hashes: Column, known: Column, templates: list[tuple[str, str]], dice: float) -> Column:
    """Array of (licence, dice): the best stretch of each template, unless a better one overlaps it.

    2 * hits - d * length is d times the template's size or more only where the coefficient is d or more. So the stretch with the
    largest such sum is taken for d = ``dice``, and again for the coefficient that it has, ``ROUNDS`` times: the coefficient
    never falls, and where it stays no stretch has a larger one. The search counts bigrams as often as they stand there, the
    coefficient once; as copies may follow each other, it goes from both ends and a stretch ends where a whole template can be in it.
    """
    near = let(F.array_distinct(hashes), lambda d: F.filter(
        F.transform(known, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.size(F.array_intersect(d, x["t"]["bigrams"])) >= x["t"]["least"]))

    def search(near: Column, *found: Column) -> Column:
        last = F.size(hashes) - 1

        def of_template(x: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (x["i"] % MARKS).cast("int"))
            mine = found[0] if len(found) == 1 else F.element_at(F.array(*found), (x["i"] / MARKS).cast("int") + 1)
            # Looked for once, as the search goes over the text several times.
            places = let(F.struct(bit.alias("bit"), mine.alias("found")), lambda m: F.filter(up_to(last + 1), lambda at: F.get(m["found"], at).bitwiseAND(m["bit"]) != 0))
            return let(places, lambda at: best_of(x["t"], at))

        def best_of(t: Column, places: Column) -> Column:
            def judged(w: Column) -> Column:
                return let(F.array_distinct(F.slice(hashes, w["a"] + 1, w["b"] - w["a"] + 1)), lambda d: F.struct(
                    t["licence"].alias("licence"), F.when(w["a"] < 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(d, t["bigrams"])) / (F.size(d) + t["n"])).alias("dice"),
                    w["a"].alias("a"), w["b"].alias("b")))

            back = F.transform(F.reverse(places), lambda at: last - at)
            turned = lambda w: F.struct(w["sum"].alias("sum"), F.when(w["a"] < 0, -1).otherwise(last - w["b"]).alias("a"), (last - w["a"]).alias("b"))

            def raised(best: Column, rounds: int) -> Column:
                if not rounds:
                    return best
                again = let(let(stretch(places, best["dice"], t["places"]), judged), lambda r: F.when(r["dice"] > best["dice"], raised(r, rounds - 1)).otherwise(best))
                return F.when(best["dice"] >= dice, again).otherwise(best)

            def from_both_ends(w: Column) -> Column:
                ways = F.array(judged(w), let(let(stretch(back, F.lit(dice), t["places"]), turned), judged))
                return let(ways, lambda v: F.when(F.get(v, 1)["dice"] > F.get(v, 0)["dice"], F.get(v, 1)).otherwise(F.get(v, 0)))

            # Far from the sum that a stretch needs there is none.
            return let(stretch(places, F.lit(dice), t["places"]), lambda w: F.when(
                w["sum"] >= 0.5 * dice * t["n"], let(from_both_ends(w), lambda r: raised(r, ROUNDS))))

        hits = F.filter(F.transform(near, of_template), lambda w: w["dice"] >= dice)
        alone = let(hits, lambda ws: F.filter(ws, lambda w: ~F.exists(ws, lambda v: (v["dice"] > w["dice"]) & (v["a"] <= w["b"]) & (w["a"] <= v["b"]))))
        return F.transform(alone, lambda w: F.struct(w["licence"].alias("licence"), w["dice"].alias("dice")))

    empty = F.array().cast("array<struct<licence:string,dice:double>>")
    masks = marks(hashes, templates)
    together = F.struct(*[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return let(near, lambda x: F.when(F.size(x) == 0, empty).otherwise(let(together, lambda m: search(x, *[m[f"m{i}"] for i in range(len(masks))]))))


def matches(text: Column, templates: list[tuple[str, str]], dice: float = DICE) -> Column:
    """Array of (licence, dice) of every unit and template, and of every stretch of the rest, with at least ``dice``."""
    known, fewest, most_bigrams = template_column(templates, dice)
    empty = F.array().cast("array<struct<licence:string,dice:double>>")

    def compare(bigrams: Column) -> Column:
        admitted = F.filter(known, lambda t: (F.size(bigrams) >= t["least"]) & (F.size(bigrams) <= t["most"]))
        scored = F.transform(admitted, lambda t: F.struct(
            t["licence"].alias("licence"), (2.0 * F.size(F.array_intersect(bigrams, t["bigrams"])) / (F.size(bigrams) + t["n"])).alias("dice")
        ))
        return F.filter(scored, lambda s: s["dice"] >= dice)

    def unit(words: Column) -> Column:
        pairs = F.array_distinct(bigram_hashes(words))
        # Fewer words than the smallest template's bound cannot reach it; the largest bound holds for different bigrams.
        return F.when(F.size(words) - 1 >= max(fewest, 1), let(pairs, lambda b: F.when(F.size(b) <= most_bigrams, compare(b)).otherwise(empty))).otherwise(empty)

    def whole(clean: Column) -> Column:
        scored = F.filter(F.transform(units(clean), lambda u: F.struct(u.alias("u"), let(words_in(u), unit).alias("m"))), lambda x: F.size(x["m"]) > 0)

        def with_rest(found: Column) -> Column:
            names = F.transform(found, lambda x: x["u"])
            # What a unit has settled is a word that no template has.
            left = lambda parts: F.transform(parts, lambda x: F.when(F.array_contains(names, one_line(x)), F.lit("|")).otherwise(x))
            paragraphs = F.concat_ws("\n", left(F.split(clean, r"\n *\n")))
            rest = F.when(F.array_contains(names, one_line(clean)), F.lit("")).otherwise(F.concat_ws(" ", left(F.split(paragraphs, "\n"))))
            stretches = let(let(words_in(rest), bigram_hashes), lambda h: windows(h, known, templates, dice))
            return F.concat(F.flatten(F.transform(found, lambda x: x["m"])), stretches)

        return let(scored, with_rest)

    def lowered(low: Column) -> Column:
        stems = stems_of(tuple(templates), dice)
        if stems is None:
            return let(cleaned(low), whole)
        possible = F.lit(False)
        for stem in stems:
            possible = possible | low.contains(stem)
        return F.when(possible, let(cleaned(low), whole)).otherwise(empty)

    return let(F.lower(text), lowered)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text", dice: float = DICE) -> DataFrame:
    """``docs`` without its text, with ``licences``: array of (licence, dice), the best unit of each licence, by name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    found = matches(text_of(text), templates or TEMPLATES + BODIES, dice)

    def best(m: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["licence"])))
        return F.transform(names, lambda n: F.struct(
            n.alias("licence"), F.array_max(F.transform(F.filter(m, lambda x: x["licence"] == n), lambda x: x["dice"])).alias("dice")
        ))

    return docs.select(*rest, let(found, best).alias("licences"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_licences"),
        F.concat_ws(",", F.transform("licences", lambda x: x["licence"])).alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("licences", lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )
