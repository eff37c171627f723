"""Operator 5: benchmark decontamination by template windows, with DataFrame functions only.

Canonical text: capitalised words inside a sentence become a name placeholder, numbers a number placeholder,
units after numbers a unit placeholder; the rest is lower-cased and cut into letter runs. A template window
is ``window`` tokens (all tokens of a shorter item, but at least three); windows that are mostly placeholders
are not used. An item without such windows (arithmetic, tables, one or two words) is found by windows of its
values instead: numbers and words as they stand, but for case, so a copy of one word is found wherever the word
is. Windows of documents meet windows of items by an equality join on their hashes. A document has
an item if ``coverage`` of the item's windows are in it and its slots are consistent: where the same value
stands in the item, the document has one and the same value (but for a share of ``tolerance`` of the values), and
different values of the item are different ones in the document (at least a share of ``distinct`` of them). So a
question with other numbers or names is caught and a text that only shares the form is not. Slots are judged over
all places of the item in the document and, if these contradict each other (several copies, parallel clauses), for
each alignment by itself: one that has the coverage and is consistent is enough, and the figures are its own. A
verbatim copy is consistent with itself, so it is always found.

A null or empty text has no windows; an item without letters and digits is never found. Texts of any length are
read whole. Rows of one doc_id count together, rows without one too; a null item_id is an id like any other.
Different texts of one item_id are items of their own. Repeated items and rows give one row a pair of ids, that of
the largest coverage (ties: most windows, fewest changed values). Further columns, whatever their names, are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.storage import materialize

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_NUMBERS = "[0-9]+(?:[.,:/][0-9]+)*"
_NAMES = r"\p{Lu}(?<=[\p{Ll},;]\s\p{Lu})\p{Ll}++(?![\p{L}\p{M}])"
#: Units, lower case.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr ms kb mb gb tb w kw mw v a hz khz mhz ghz k c f percent usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles feet inches grams kilograms liters litres seconds minutes hours days weeks months years degrees".split()
#: A broadcast side has at most so many windows (16 bytes each).
BROADCAST = 1_000_000


def tokens(text) -> F.Column:
    """The canonical tokens of a text."""
    t = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    t = F.regexp_replace(t, _NAMES, f" {NAME} ")
    t = F.regexp_replace(t, _NUMBERS, f" {NUMBER} ")
    t = F.regexp_replace(F.lower(t), rf"{NUMBER}\s*(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", f"{NUMBER} {UNIT} ")
    return F.array_remove(F.split(t, rf"[^\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+"), "")


def raw_tokens(text) -> F.Column:
    """The values behind the canonical tokens, place by place."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   "), F.lit(rf"({_NUMBERS}|[\p{{L}}\p{{M}}]+)"), 1)


def _values(text) -> F.Column:
    """The raw tokens, lower-cased."""
    return F.transform(raw_tokens(text), F.lower)


_MOSTLY_WORDS = f"2 * size(filter({{}}, t -> t in ('{NUMBER}', '{NAME}', '{UNIT}'))) <= width"


def _hashes(size: int) -> str:
    """SQL for the (i, width, hash) of each window of tokens of a size."""
    return f"if(size(tokens) >= {size}, transform(sequence(0, greatest(0, size(tokens) - {size})), i -> struct(i as i, {size} as width, xxhash64(slice(tokens, i + 1, {size})) as hash)), cast(array() as array<struct<i:int,width:int,hash:bigint>>))"


def _windows(items: DataFrame) -> DataFrame:
    """item_id, j, width and w, the tokens, of each window of items (item_id, width, tokens)."""
    starts = items.select("item_id", "width", "tokens", F.expr("explode(sequence(1, size(tokens) - width + 1)) as j"))
    return starts.select("item_id", "j", "width", F.expr("slice(tokens, j, width)").alias("w"))


def _meet(hashed: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, copy, item_id, shift, js and width where windows of documents (doc_id, copy, tokens) are items' windows."""
    if not widths:
        return windows.where("false").select(F.lit(None).cast(hashed.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("copy"), "item_id", F.lit(0).alias("shift"), F.array("j").alias("js"), "width")
    every = F.expr(f"concat({', '.join(map(_hashes, widths))})")  # one pass over the tokens for all widths
    own = hashed.select("doc_id", "copy", F.explode(every).alias("v")).select("doc_id", "copy", "v.i", "v.width", "v.hash")
    side = F.broadcast(windows) if windows.count() <= BROADCAST else windows
    met = own.join(side, ["hash", "width"]).groupBy("doc_id", "copy", "item_id", (F.col("i") + 1 - F.col("j")).alias("shift")).agg(F.collect_set("j").alias("js"), F.first("width").alias("width"))
    return materialize(met, "met", small=True)


def _covered(met: DataFrame, windows: DataFrame, coverage: float) -> DataFrame:
    """doc_id, item_id, m (windows of the item), n_windows and coverage of pairs with enough of the windows."""
    sizes = windows.groupBy("item_id").agg(F.countDistinct("j").alias("m"))
    total = met.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).cast("long").alias("n_windows"))
    return total.join(sizes, "item_id").where(F.col("n_windows") >= coverage * F.col("m")).withColumn("coverage", F.col("n_windows") / F.col("m"))


def _slots(spots: DataFrame, *keys: str) -> DataFrame:
    """n_slots, conflicts (values of the item with several in the document), n_changed and n_now (different values in
    the document) of each group of spots (was, now)."""
    slots = spots.distinct().groupBy(*keys, "was").agg(F.count("*").alias("n"), F.max(F.expr("not (was <=> now)")).alias("changed"), F.min("now").alias("now"))
    return slots.groupBy(*keys).agg(F.count("*").alias("n_slots"), F.sum(F.expr("int(n > 1)")).alias("conflicts"), F.sum(F.expr("int(changed)")).alias("n_changed"), F.size(F.collect_set("now")).alias("n_now"))


def _consistent(tolerance: float, distinct: float) -> str:
    return f"(coalesce(conflicts, 0) <= {tolerance!r}D * coalesce(n_slots, 0) and coalesce(n_now, 0) >= {distinct!r}D * coalesce(n_slots, 0))"


def _same(a: DataFrame, b: DataFrame, *keys: str):
    return functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _aligned(at: DataFrame, failed: DataFrame, coverage: float, agree: str) -> DataFrame:
    """The best consistent alignment of each failed pair (doc_id, item_id, m) that has one.

    at has doc_id, copy, item_id, shift, js, reach and places. A shift alone is an alignment; so is a shift with
    what it lacks taken from the nearest other shifts, as far as the item is long (words put in or left out).
    """
    f = failed.select(F.col("doc_id").alias("d"), F.col("item_id").alias("t"), "m")
    at = at.join(f, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("t"))).drop("d", "t")
    at = materialize(at, "alignments", small=True)
    key = ["doc_id", "copy", "item_id", "anchor", "alone"]
    a = at.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("item_id").alias("t"), F.col("shift").alias("anchor"))
    near = at.join(a, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")) & (F.col("item_id") == F.col("t")) & (F.abs(F.col("shift") - F.col("anchor")) <= F.col("reach"))).drop("d", "c", "t")
    rows = near.withColumn("alone", F.explode(F.when(F.col("shift") == F.col("anchor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    sizes = rows.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).cast("long").alias("n_windows"), F.first("m").alias("m"))
    sizes = sizes.where(F.col("n_windows") >= coverage * F.col("m"))
    spots = rows.select(*key, "shift", F.explode("places").alias("s")).groupBy(*key, "s.p").agg(F.min_by("s", F.struct(F.abs(F.col("shift") - F.col("anchor")), "shift")).alias("s"))
    slots = _slots(spots.select(*key, "s.was", "s.now"), *key)
    good = sizes.join(slots, _same(sizes, slots, *key), "left").where(agree)
    best = good.groupBy(sizes["doc_id"], sizes["item_id"]).agg(F.max(F.struct("n_windows", (-F.coalesce("n_changed", F.lit(0))).alias("kept"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "m")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", (F.col("b.n_windows") / F.col("b.m")).alias("coverage"), F.col("b.n_slots").cast("long").alias("n_slots"), (-F.col("b.kept")).cast("long").alias("n_changed"))


def find_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, tolerance: float = 0.1, distinct: float = 0.5, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots and n_changed of each item that is in a document."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("copy"))
    items = benchmark.select(F.col(item_id).alias("own_id"), F.col(text).alias("text"))
    items = items.select(F.xxhash64(F.col("own_id").isNull(), "own_id", "text").alias("item_id"), "own_id", "text").distinct()
    names = items.select("item_id", "own_id")
    items = items.select("item_id", "text", tokens(F.col("text")).alias("tokens"), _values(F.col("text")).alias("values"))
    items = items.withColumn("width", F.least(F.lit(window), F.size("tokens")))
    formal = F.expr(f"size(tokens) >= 3 and exists(sequence(1, size(tokens) - width + 1), j -> {_MOSTLY_WORDS.format('slice(tokens, j, width)')})")
    templates, verbatim = items.where(formal), items.where(~formal & (F.size("values") > 0))
    found = _by_template(docs, templates, coverage, _consistent(tolerance, distinct))
    if not verbatim.isEmpty():
        found = found.union(_by_value(docs, verbatim.select("item_id", F.least(F.lit(window), F.size("values")).alias("width"), F.col("values").alias("tokens")), coverage))
    best = F.max(F.struct("coverage", "n_windows", (-F.col("n_changed")).alias("kept"), "n_slots")).alias("b")
    best = found.join(names, "item_id").groupBy("doc_id", "own_id").agg(best)
    return best.select("doc_id", F.col("own_id").alias("item_id"), "b.n_windows", "b.coverage", "b.n_slots", (-F.col("b.kept")).alias("n_changed"))


def _windowed(part: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, j, width and hash of windows, and their widths: at most ``window`` values."""
    windows = materialize(part.select("item_id", "j", "width", F.xxhash64("w").alias("hash")).distinct(), "windows", small=True)
    return windows, sorted(r[0] for r in windows.select("width").distinct().collect())


def _by_value(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """Items (item_id, width, tokens) found by windows of their values as they stand: no slot is open."""
    windows, widths = _windowed(_windows(items))
    met = _meet(docs.select("doc_id", "copy", _values(F.col("text")).alias("tokens")), windows, widths)
    nothing = F.lit(0).cast("long")
    return _covered(met, windows, coverage).select("doc_id", "item_id", "n_windows", "coverage", nothing.alias("n_slots"), nothing.alias("n_changed"))


def _by_template(docs: DataFrame, items: DataFrame, coverage: float, agree: str) -> DataFrame:
    """Items (item_id, text, width, tokens) found by template windows."""
    windows, widths = _windowed(_windows(items).where(F.expr(_MOSTLY_WORDS.format("w"))))
    met = _meet(docs.select("doc_id", "copy", tokens(F.col("text")).alias("tokens")), windows, widths)
    total = _covered(met, windows, coverage)
    # slots: only items that have placeholders need the documents' values
    slotted = items.where(F.expr(f"exists(tokens, t -> t in ('{NUMBER}', '{NAME}', '{UNIT}'))")).select("item_id", "tokens", raw_tokens(F.col("text")).alias("item_raw"))
    wanted = materialize(met.join(total.select("doc_id", "item_id"), (met["doc_id"].eqNullSafe(total["doc_id"])) & (met["item_id"] == total["item_id"]), "left_semi").join(slotted, "item_id"), "slots", small=True)
    nothing = F.lit(0).cast("long")
    if wanted.isEmpty():
        return total.select("doc_id", "item_id", "n_windows", "coverage", nothing.alias("n_slots"), nothing.alias("n_changed"))
    at = materialize(_places(docs, wanted), "places", small=True)
    # first all shifts together, then, where these contradict each other, each alignment by itself
    s = _slots(at.select("doc_id", "item_id", F.explode("places").alias("s")).select("doc_id", "item_id", "s.was", "s.now"), "doc_id", "item_id")
    s = s.select(F.col("doc_id").alias("d"), F.col("item_id").alias("t"), "n_slots", "conflicts", "n_changed", "n_now")
    judged = materialize(total.join(s, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("t")), "left"), "judged", small=True)
    found = judged.where(agree).select("doc_id", "item_id", "n_windows", "coverage", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))
    failed = judged.where(f"not {agree}")
    return found if failed.isEmpty() else found.union(_aligned(at, failed, coverage, agree))


def _places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, copy, item_id, shift, js, reach (the item's length) and places (p, was, now): the item's placeholders
    that its windows cover and the document has there too. A document is tokenised once, and only the values of
    places that are asked for leave it."""
    key = ["doc_id", "copy", "item_id", "shift"]
    placed = F.expr(f"explode(filter(array_distinct(flatten(transform(js, j -> sequence(j, j + width - 1)))), p -> get(tokens, p - 1) in ('{NUMBER}', '{NAME}', '{UNIT}')))")
    spots = wanted.select(*key, placed.alias("p"), "tokens", "item_raw").select(*key, "p", (F.col("p") - 1 + F.col("shift")).alias("q"), F.expr("get(tokens, p - 1)").alias("kind"), F.expr("get(item_raw, p - 1)").alias("was"))
    asked = spots.groupBy("doc_id", "copy").agg(F.collect_set("q").alias("qs"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "text")
    read = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))).select("d", "c", "qs", tokens(F.col("text")).alias("own"), raw_tokens(F.col("text")).alias("raw"))
    values = read.select("d", "c", F.explode(F.expr("transform(qs, q -> struct(q as at, get(own, q) as own, get(raw, q) as now))")).alias("v")).select("d", "c", "v.at", "v.own", "v.now").distinct()
    met = spots.join(values, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")) & (F.col("q") == F.col("at")) & (F.col("kind") == F.col("own")))
    places = met.groupBy(*key).agg(F.collect_list(F.struct("p", "was", "now")).alias("places"))
    alignments = wanted.select(*key, "js", F.size("tokens").alias("reach"))
    return alignments.join(places, _same(alignments, places, *key), "left").select(*[alignments[k] for k in key], "js", "reach", F.coalesce("places", F.array().cast("array<struct<p:int,was:string,now:string>>")).alias("places"))
