"""Benchmark passages in documents, by winnowed fingerprints; DataFrame functions only.

Of the hashes of k words in a row, the smallest in each run of w is kept with its place, so any span of w + k - 1 words
that a document shares with an item gives both the same kept hash at the same place of the span. A shared hash is a
seed; it aligns the item with the document, and the alignment is extended word by word to the windows that really occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import checkpointed

GRAM, RUN = 5, 9
WINDOW = GRAM + RUN - 1
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The upper bits of a kept number are the hash's, the lower ones those of its place.
_PLACE_BITS = 24
_PLACES = (1 << _PLACE_BITS) - 1
#: What is broadcast at most: seeds of items (of 32 bytes), documents with seeds, bytes of items or of what documents
#: with seeds share. Beyond any of these both sides are dealt by key.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the faster ``lower`` where it does just that."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(_OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def item_words(text: str) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(F.col(text)), _BETWEEN), ""), F.array().cast("array<string>"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, f) -> Column:
    """``f(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _upto(last: Column) -> Column:
    """0 to ``last``; nothing if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(_none("int"))


def _ranks(k: int) -> Column:
    """For every k words in a row (whose hashes are in ``hashes``) their hash and place in one number."""
    hashed = lambda i: F.xxhash64(*(F.col("hashes")[i + j] for j in range(k)))
    placed = lambda i: hashed(i).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(i.bitwiseAND(F.lit(_PLACES)).cast("long"))
    return F.transform(_upto(F.size("hashes") - k), placed)


def _prints(texts: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """keys, n (words hashed; 0 for a winnowed hash), hash, place: what a text (``words``) may share with an item.

    Items shorter than a window are looked up whole, so documents get the hashes of all their runs of those lengths.
    """
    hashed = texts.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    ranked = hashed.select(*keys, "hashes", _ranks(GRAM).alias("ranks"))
    least = F.transform(_upto(F.size("ranks") - RUN), lambda i: F.least(*(F.col("ranks")[i + j] for j in range(RUN))))
    labelled = lambda n, ranks: F.transform(ranks, lambda r: F.struct(F.lit(n).alias("n"), r.alias("rank")))
    found = F.concat(labelled(0, F.array_distinct(least)), *(labelled(m, _ranks(m)) for m in short))
    # explode() would push a filter on the array's size, and with it the whole expression, down into the scan
    each = ranked.select(*keys, F.explode_outer(found).alias("p")).where("p IS NOT NULL")
    return each.select(*keys, "p.n", F.shiftright("p.rank", _PLACE_BITS).alias("hash"), F.col("p.rank").bitwiseAND(F.lit(_PLACES)).cast("int").alias("place"))


def _bounded(rows: DataFrame, size: Column) -> DataFrame:
    """``rows``, to be broadcast if they are few and small."""
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else rows


def _covered(words: str, item: Column, start: Column) -> Column:
    """The places of the document's words that lie in a window of the item, all of whose words agree, if the item begins
    at ``start``: between the words that differ, the stretches of a window's length or more."""
    low, high = F.greatest(F.lit(0), -start), F.least(F.size(item), F.size(words) - start)
    differ = F.filter(F.sequence(low, high - 1), lambda j: F.col(words)[start + j] != item[j])
    span = F.least(F.size(item), F.lit(WINDOW))

    def stretches(ends: Column) -> Column:
        long_ones = F.filter(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: ends[k + 1] - ends[k] > span)
        return F.flatten(F.transform(long_ones, lambda k: F.sequence(start + ends[k] + 1, start + ends[k + 1] - 1)))

    return F.when(high - low >= span, _let(F.concat(F.array(low - 1), differ, F.array(high)), stretches)).otherwise(_none("int"))


def _hits(words: str, met: str) -> Column:
    """array<struct<item_id, at>>: for each item and alignment, the places of the words its windows cover."""
    turns = F.shiftright(F.size(words) - 1, _PLACE_BITS)  # places repeat after 2^24 words

    def of_item(m: Column) -> Column:
        starts = F.flatten(F.transform(m["starts"], lambda s: F.transform(F.sequence(F.lit(0), turns), lambda k: s + k * (_PLACES + 1))))
        return F.transform(starts, lambda s: F.struct(m["item_id"].alias("item_id"), _covered(words, m["item"], s).alias("at")))

    return F.filter(F.flatten(F.transform(met, of_item)), lambda h: F.size(h["at"]) > 0)


def contaminated(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with the benchmark ``items`` (item_id, text) that occur in them.

    Adds n_words, n_hit (words inside an occurring window of 13 words, or of the whole of a shorter item), items
    (array<string> of the ids with occurring windows, sorted) and contaminated (n_hit > 0 and share * n_hit >=
    n_words). Null or wordless texts have no words and no hits; items with a null id, or without words, occur
    nowhere; items that repeat an id count once. Repeated rows and extra columns of ``docs`` stay as they are;
    an extra column named like an added one is replaced.
    """
    named = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), item_words("text").alias("words"))
    wordy = named.where("size(words) > 0").select("item_id", "words", F.xxhash64("item_id", "words").alias("key")).distinct()
    short = sorted(r[0] for r in wordy.select(F.size("words")).where(f"size(words) < {WINDOW}").distinct().collect())  # twelve at most
    ours = _prints(wordy.withColumn("long", F.size("words")), ["key", "long"], short).where("n = 0 OR n = long")
    seeds = _bounded(ours.select("key", "n", "hash", F.col("place").alias("q")), F.lit(32))
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__text"), item_words("text").alias("words"))
    seeded = _prints(keyed, ["__doc", "__text"], short).join(seeds, ["n", "hash"]).groupBy("__doc", "__text", "key").agg(F.collect_set(F.col("place") - F.col("q")).alias("starts"))
    whole = _bounded(wordy.withColumnRenamed("words", "item"), F.octet_length(F.array_join("item", " ")))
    each = seeded.join(whole, "key").groupBy("__doc", "__text").agg(F.collect_list(F.struct("item_id", "item", "starts")).alias("__met"))
    met = _bounded(checkpointed(each), F.aggregate("__met", F.lit(0), lambda n, m: n + F.octet_length(F.array_join(m["item"], " ")) + 4 * F.size(m["starts"])))
    joined = docs.join(met, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__text")), "left")
    parsed = joined.withColumn("__words", item_words("text")).withColumn("n_words", F.size("__words").cast("long"))
    hits = F.when(F.col("__met").isNull(), _none("struct<item_id:string,at:array<int>>")).otherwise(_hits("__words", "__met"))
    # generated, so that a caller's filter on what follows isn't pushed down with the whole expression, lambdas and all
    found = parsed.select("*", F.explode_outer(F.array(hits)).alias("__hits"))
    out = found.withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["at"])))).cast("long"))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["item_id"]))))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("__doc", "__text", "__met", "__words", "__hits")


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
