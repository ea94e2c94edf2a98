"""Benchmark decontamination by a distributed positional inverted index, all in DataFrame functions.

A benchmark item is cut into windows of consecutive words (phrases). The index has the postings (term,
text, position) of the corpus for every term that a phrase may ask for first or second. For
each phrase its two rarest terms are chosen by their counts over the whole corpus; their posting lists are
shifted by the terms' places in the item and intersected, which leaves few (item, text, shift)
alignments. Along an alignment all phrases of the item are compared word for word at once.

Equal texts are one from the start, so a group of copies asks once. A frequent term is in the
index only if some phrase has nothing rarer; its rows are spread by (text, shift), and adaptive execution splits
the one join by term. No side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import stored, unused

WINDOW = 10
#: What separates words, after lower-casing A-Z: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text; none for a null."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item, item_id, words, n, size (words of a window) of the items with words, each once."""
    rows = benchmark.select("item_id", words("text").alias("words")).distinct()
    kept = rows.where("size(words) > 0").withColumn("n", F.size("words"))
    # Items are told apart by id and words, as an id may be null or repeated.
    return kept.withColumn("item", F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "words"))).withColumn(
        "size", F.least("n", F.lit(window))
    )


def _asked(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, n, o1, t1, o2, t2: the two rarest terms of each phrase with their places in the item.

    The second is null in a phrase of one word. Neighbouring phrases mostly ask the same.
    """
    terms = items.select("item", "n", "size", F.posexplode("words").alias("o", "term"))
    rarity = terms.join(counts, "term", "left").select(
        "item", "n", "size", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "o", "term").alias("t")
    )
    whole = rarity.groupBy("item", "n", "size").agg(F.array_sort(F.collect_list("t"), lambda a, b: a["o"] - b["o"]).alias("t"))
    phrase = whole.select(
        "item",
        "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("n") - F.col("size") + 1),
                lambda i: F.slice(F.array_sort(F.slice("t", i, F.col("size"))), 1, 2),
            )
        ).alias("rare"),
    )
    first, second = F.get("rare", F.lit(0)), F.get("rare", F.lit(1))
    return phrase.select(
        "item", "n", first["o"].alias("o1"), first["term"].alias("t1"), second["o"].alias("o2"), second["term"].alias("t2")
    ).distinct()


def index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, digest, pos: the postings of the given terms (column term, each once) in texts (digest, words)."""
    return (
        texts.select("digest", F.posexplode("words").alias("pos", "term")).join(terms, "term").select("term", "digest", "pos")
    ).distinct()


def alignments(postings: DataFrame, asked: DataFrame, slop: int = 0) -> DataFrame:
    """digest, item, n, delta: where both terms of a phrase stand as in the item.

    ``delta`` is the place of the item's first word in the text. With ``slop`` the second term may be
    up to that many words nearer or farther.
    """
    number = asked.withColumn("phrase", F.xxhash64("item", "o1", "o2"))
    one = number.join(postings, F.col("t1") == F.col("term")).select(
        "digest", "item", "n", "phrase", (F.col("pos") - F.col("o1")).alias("delta"), "t2"
    )
    single = one.where("t2 IS NULL").select("digest", "item", "n", "delta")
    two = (
        number.where("t2 IS NOT NULL")
        .join(postings, F.col("t2") == F.col("term"))
        .select("digest", "item", "phrase", (F.col("pos") - F.col("o2")).alias("near"))
    )
    if slop:
        two = two.select("digest", "item", "phrase", F.explode(F.sequence(F.col("near") - slop, F.col("near") + slop)).alias("near"))
    both = one.where("t2 IS NOT NULL").join(
        two.withColumnRenamed("near", "delta"), ["digest", "item", "phrase", "delta"], "left_semi"
    )
    return both.select("digest", "item", "n", "delta").union(single).distinct()


def phrase_hits(corpus: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """digest, item_id, size, starts: the exact phrases along alignments, by their places in the text.

    ``corpus`` has a row for each text (digest, words) with alignments at least.
    """
    places = found.groupBy("digest").agg(F.collect_list(F.struct("item", "n", "delta")).alias("places"))

    def cut(place: Column) -> Column:
        low = F.greatest(place["delta"], F.lit(0))
        length = F.least(F.size("words") - low, place["n"] - low + place["delta"])
        return F.struct(
            place["item"].alias("item"),
            place["delta"].alias("delta"),
            low.alias("low"),
            F.slice("words", low + 1, F.greatest(length, F.lit(0))).alias("part"),
        )

    parts = corpus.join(places, "digest").select("digest", F.explode(F.transform("places", cut)).alias("p")).select("digest", "p.*")
    pairs = parts.join(items.select("item", "item_id", "size", F.col("words").alias("whole")), "item")
    other = F.slice("whole", F.col("low") - F.col("delta") + 1, F.size("part"))
    pairs = pairs.where(F.size("part") >= F.col("size")).withColumn("other", other)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("part") - F.col("size")),
        lambda i: F.slice("part", i + 1, F.col("size")) == F.slice("other", i + 1, F.col("size")),
    )
    return (
        pairs.select("digest", "item_id", "low", "size", starts.alias("at"))
        .where("size(at) > 0")
        .select("digest", "item_id", "size", F.transform("at", lambda i: F.col("low") + i).alias("starts"))
    )


def _prepared(documents: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    items = stored(items_of(benchmark, window))
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct())
    texts = documents.select(digest("text").alias("digest"), words("text").alias("words"))
    counts = texts.select(F.explode("words").alias("term")).join(vocabulary, "term").groupBy("term").count()
    asked = stored(_asked(items, counts))
    terms = stored(
        asked.select(F.col("t1").alias("term")).union(asked.where("t2 IS NOT NULL").select(F.col("t2").alias("term"))).distinct()
    )
    return items, asked, stored(index(texts, terms)), texts


def near_matches(documents: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id: where the two rarest terms of a phrase stand at most ``slop`` words out of place."""
    items, asked, postings, _ = _prepared(documents, benchmark, window)
    found = alignments(postings, asked, slop).select("digest", "item").distinct()
    named = found.join(items.select("item", "item_id"), "item").select("digest", "item_id").distinct()
    return documents.select("doc_id", digest("text").alias("digest")).join(named, "digest").select("doc_id", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) of every row of ``documents``.

    A null text has no words, like an empty one, and items without words ask nothing. An item of
    fewer than ``window`` words is one phrase. Each row is judged by itself; repeated rows and ids, also null ones,
    stay. Repeated items count once; an item without id hits words, but is not counted or
    listed. Other columns are not read.
    """
    items, asked, postings, texts = _prepared(documents, benchmark, window)
    found = stored(alignments(postings, asked))
    # Words again only of texts with an alignment, and of equal texts once.
    corpus = (
        texts.join(found.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("words").alias("words"))
    )
    hits = phrase_hits(corpus, items, found)
    covered = F.flatten(
        F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))
    )
    of_text = (
        hits.select("digest", "item_id", F.array_distinct(covered).alias("covered"))
        .groupBy("digest")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_hit"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        )
    )
    rows = documents.select("doc_id", digest("text").alias("digest"), F.size(words("text")).cast("long").alias("n_words"))
    return rows.join(of_text, "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` whose text has no phrase of an item, with all their columns, whatever the names.

    Null and empty texts have no phrase and stay; repeated rows stay or go together; without items or documents
    nothing goes.
    """
    items, asked, postings, texts = _prepared(documents, benchmark, window)
    found = stored(alignments(postings, asked))
    corpus = (
        texts.join(found.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("words").alias("words"))
    )
    name = unused("_digest", documents)
    bad = phrase_hits(corpus, items, found).select(F.col("digest").alias(name)).distinct()
    return documents.join(bad, digest("text") == F.col(name), "left_anti")
