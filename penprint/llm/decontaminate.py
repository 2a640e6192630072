"""Benchmark decontamination by templates, in DataFrame functions.

Numbers, names and units are replaced by typed placeholders, so a question with
other numbers or names has the same template.  Every window of ``WINDOW``
template tokens of every document is hash-joined with the windows of the
benchmark items.  A document and item that share enough windows are compared
slot by slot: the values that stand in the item's slots must map one to one to
those in the document's (all equal: the passage itself; else a re-parameterised
question).  Every place of the document that holds enough windows alone is
compared, and the longest consistent one is reported.

Tokens are runs of letters, numbers, and percent or currency signs.  A name is a
capitalised word inside a sentence; the first word of a sentence is an ordinary
word.  Windows with fewer than ``TELLING`` ordinary words (lists of numbers or
names) are compared by their values instead of placeholders: such a list matches
its own copy only.

An item shorter than a window is one window of its own length.  The first word of
an item is a name in a document where no sentence ends before it (after a colon
or a heading); the item's first window is indexed in that form too, and counts if
the name is the item's word.

Edge cases: a null text has no tokens; an item of fewer than ``SHORTEST`` tokens
matches nothing; null ids are kept and match each other; rows equal in
id and text give one row for each item; an item or document repeated under
several ids is reported under each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from penprint.llm.frames import saved

WINDOW = 8
TELLING = 4
COVERAGE = 0.3
MIN_WINDOWS = 3
SHORTEST = 3
CONSISTENCY = 0.7
#: Largest table of item windows that is sent to every executor.
BROADCAST_WINDOWS = 500_000

TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*|[.!?]+|[%$€£°]"
# Units of measure, lower case.
UNITS = ("% $ € £ ° mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
         "lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min "
         "minute minutes hour hours h day days week weeks month months year years mph kmh dollar dollars cent cents "
         "euro euros percent degree degrees").split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


def template(text: Column) -> Column:
    """array<struct<t, v>>: template token and the value in its slot (empty for
    an ordinary word)."""
    def tokens(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low = F.lower(w)
            first = F.substring(w, 1, 1)
            opens = (i == 0) | F.substring(ws[F.greatest(i - 1, F.lit(0))], 1, 1).isin(".", "!", "?")
            title = (first != F.lower(first)) & (F.substring(w, 2, 1 << 20) == F.substring(low, 2, 1 << 20))
            kind = (F.when(first.between("0", "9"), NUM).when(low.isin(UNITS), UNIT)
                    .when(title & ~opens & (F.length(w) > 1), NAME).otherwise(low))
            return F.struct(kind.alias("t"), F.when(kind.isin(NUM, NAME, UNIT), low).otherwise("").alias("v"))
        return F.filter(F.transform(ws, one), lambda x: ~F.substring(x["t"], 1, 1).isin(".", "!", "?"))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(F.array(words), tokens)[0]  # the words are bound once


def window_hashes(tokens: Column, width: int | Column = WINDOW, values: bool = True) -> Column:
    """Hash of every window of ``width`` template tokens, by its place; with
    ``values``, windows with few ordinary words are hashed with their values."""
    def hashes(b: Column) -> Column:
        ts, vs = b["t"], b["v"]

        def one(i: Column) -> Column:
            plain = F.xxhash64(F.slice(ts, i, width))
            if not values:
                return plain
            slots = F.size(F.array_remove(F.slice(vs, i, width), ""))
            return F.when(F.lit(width) - slots >= TELLING, plain).otherwise(
                F.xxhash64(F.slice(ts, i, width), F.slice(vs, i, width)))
        return F.when(F.size(ts) >= width, F.transform(F.sequence(F.lit(1), F.size(ts) - (width - 1)), one)).otherwise(
            F.array().cast("array<long>"))
    # bound once each: the tokens, then their two columns
    split = lambda x: F.transform(F.array(F.struct(x["t"].alias("t"), x["v"].alias("v"))), hashes)[0]
    return F.transform(F.array(tokens), split)[0]


def _item_windows() -> Column:
    """array<struct<ipos, h>> of the columns ``item`` and ``width``: every window
    of the item, and the first one as it is where the item's first word is a name."""
    item, width = F.col("item"), F.col("width")
    named = F.concat(F.array(F.struct(F.lit(NAME).alias("t"), item[0]["t"].alias("v"))), F.slice(item, 2, width - 1))
    at = lambda hs: F.transform(hs, lambda h, i: F.struct(i.alias("ipos"), h.alias("h")))
    first = F.when((item[0]["v"] == "") & (F.length(item[0]["t"]) > 1), at(window_hashes(named, width)))
    own = at(window_hashes(item, width))
    return F.when(F.size(item) >= SHORTEST, F.concat(own, F.coalesce(first, F.slice(own, 1, 0))))


def _enough(n: Column | str) -> Column:
    """Whether so many of an item's ``total`` windows count as the item."""
    n = F.col(n) if isinstance(n, str) else n
    return (n >= F.least(F.lit(MIN_WINDOWS), F.col("total"))) & (n >= COVERAGE * F.col("total"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, n_changed, consistency,
    kind, doc_hash) for each document and item it contains."""
    bench = saved(items.select(F.col(item_id).alias("item_id"), template(F.col(item_text)).alias("item"))
                  .withColumn("width", F.least(F.lit(WINDOW), F.size("item"))))
    index = (bench.select("item_id", "width", (F.size("item") - F.col("width") + 1).alias("total"), "item",
                          F.inline(_item_windows()))
             .withColumn("plain", F.size(F.filter(F.slice("item", F.col("ipos") + 1, F.col("width")),
                                                  lambda x: x["v"] == "")))
             .select("item_id", "width", "total", "ipos", "h",
                     # an item's first word may be a name
                     (F.col("plain") - (F.col("ipos") == 0).cast("int") < TELLING).alias("dense")))
    index = saved(index)
    # at most WINDOW widths; without dense windows no values are hashed
    n_index, widths, dense = index.agg(F.count("*"), F.collect_set("width"), F.max("dense")).first()
    index = index.drop("dense")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("doc_hash"), F.col(text_col).alias("text"))
    by_width = F.transform(F.array(template(F.col("text"))),
                           lambda ts: F.array(*[window_hashes(ts, w, bool(dense)) for w in sorted({WINDOW, *widths})]))[0]
    windows = (own.select("doc_id", "doc_hash", F.explode(by_width).alias("hashes"))
               .select("doc_id", "doc_hash", F.posexplode("hashes").alias("pos", "h")))
    side = F.broadcast(index) if n_index <= BROADCAST_WINDOWS else index
    met = (windows.join(side, "h").select("doc_id", "doc_hash", "item_id", "total", "pos", "ipos").distinct())
    # matched places by item; a diagonal is one place where the passage may stand
    lines = (met.groupBy("doc_id", "doc_hash", "item_id", "total", (F.col("pos") - F.col("ipos")).alias("shift"))
             .agg(F.collect_set("ipos").alias("at")))
    pairs = saved(lines.groupBy("doc_id", "doc_hash", "item_id", "total")
                  .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("every"),
                       F.collect_list(F.struct((-F.col("shift")).alias("back"), "at")).alias("lines"))
                  .where(_enough(F.size("every"))).drop("every"))

    # slots of the matched places: only documents with a match are read again
    wanted = pairs.select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h")).distinct()
    texts = (own.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")), "left_semi")
             .dropDuplicates(["doc_id", "doc_hash"])
             .select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), template(F.col("text")).alias("doc")))
    both = (pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_hash") == F.col("_h")))
            .join(bench.select(F.col("item_id").alias("_i"), "item", "width"), F.col("item_id").eqNullSafe(F.col("_i"))))

    def first_word(line: Column) -> Column:
        # an item's first word that is a name in the document must be the same word
        there, word = F.col("doc")[-line["back"]], F.col("item")[0]
        other = (word["v"] == "") & (there["t"] == NAME) & (there["v"] != word["t"])
        at = F.filter(line["at"], lambda p: (p > 0) | ~other)
        return F.struct(F.size(at).alias("n"), line["back"].alias("back"), at.alias("at"))

    # the longest (first of equals), and all others that are long enough alone
    both = (both.withColumn("lines", F.sort_array(F.transform("lines", first_word), asc=False))
            .withColumn("n_windows", F.size(F.array_distinct(F.flatten("lines.at"))))
            .where((F.col("n_windows") > 0) & _enough("n_windows"))
            .withColumn("lines", F.filter("lines", lambda x, i: (i == 0) | ((x["n"] > 0) & _enough(x["n"])))))

    def slots(line: Column) -> Column:
        inside = F.array_distinct(F.flatten(F.transform(line["at"], lambda p: F.sequence(p, p + F.col("width") - 1))))
        here = lambda p: F.col("doc")[p - line["back"]]
        return F.array_distinct(F.filter(F.transform(inside, lambda p: F.struct(
            F.concat(F.col("item")[p]["t"], F.col("item")[p]["v"]).alias("a"),
            F.concat(here(p)["t"], here(p)["v"]).alias("b"),
            F.col("item")[p]["v"].alias("v"))), lambda x: x["v"] != ""))

    def judged(all_slots: Column) -> Column:
        # a pair of values agrees with all others if each of them has no second partner
        alone = lambda s: F.size(F.filter(all_slots, lambda x: (x["a"] == s["a"]) | (x["b"] == s["b"]))) == 1
        n = F.size(all_slots)
        return F.struct(n.alias("n_slots"), F.size(F.filter(all_slots, lambda s: s["a"] != s["b"])).alias("n_changed"),
                        F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.filter(all_slots, alone)) / n).alias("consistency"))

    # the longest consistent place is reported
    return (both.withColumn("slots", F.transform("lines", slots))
            .withColumn("best", F.try_element_at(F.filter(F.transform("slots", judged),
                                                          lambda x: x["consistency"] >= CONSISTENCY), F.lit(1)))
            .where(F.col("best").isNotNull())
            .select("*", "best.n_slots", "best.n_changed", "best.consistency")
            .select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"),
                    (F.col("n_windows") / F.col("total")).alias("coverage"),
                    F.col("n_slots").cast("long").alias("n_slots"), F.col("n_changed").cast("long").alias("n_changed"),
                    "consistency", F.when(F.col("n_changed") == 0, "same").otherwise("reparameterised").alias("kind"),
                    "doc_hash"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("doc_hash")
