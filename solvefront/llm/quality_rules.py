"""Quality rules: cross-document line frequency, in DataFrame operations alone.

Lines are normalised (lower case, single spaces, ends cut) and hashed with
their host.  Per host and line the distinct documents are counted; lines above
the limit are removed, and a document of which too little is left is rejected.
Exact copies of a text within a host are one document here: otherwise a text
would become boilerplate by being copied, and near-duplicate removal, which
keeps one of them, would never see it.  The limit is a share of the host's
documents with a floor: small hosts need some documents to show boilerplate,
and a large one does not lose a heading because it is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import WORD_PATTERN, let, sealed, stage

#: A line stays that is in so many documents of its host, or in this share of them.
MAX_DOCS = 10
MAX_SHARE = 0.01
MIN_LEFT = 0.25
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words within 3-word windows that occur twice or more, the first included.

    ``w`` must be a bound array (see :func:`let`).  Windows are hashed; unless all
    hashes differ they are sorted with their places, neighbours of equal hash
    give the places of repeated windows, and the gaps between those give the
    words covered.  All within the row: no shuffle, O(n log n).
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(places, k + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, counted))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hash(host: Column, normal: Column) -> Column:
    """The identity of a normalised line within its host; a null host is a host of its own."""
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")), normal)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text: as empty.

    Words and lines are bound once inside one struct: a filter on a result may
    be pushed below this projection, and must not repeat the work per element.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(repeated_words(w), lambda r: F.struct(
            n.alias("n_words"), r.alias("n_repeat_words"),
            ((n < 50) | (r * 100 > n * 50)).alias("base_failed"),
        ))

    made = df.withColumn("_s", let(words(t), of_words))
    dup = let(worded_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return made.withColumns({
        "n_words": F.col("_s.n_words"), "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": F.col("_s.n_repeat_words"), "base_failed": F.col("_s.base_failed"),
    }).drop("_s")


def _document(host: str, text: str) -> Column:
    return F.xxhash64(F.col(host).isNull(), F.coalesce(F.col(host), F.lit("")), text)


def host_hash(host: Column) -> Column:
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")))


def document_lines(spark: SparkSession, df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, document, line, words), staged: the distinct lines of each distinct text of a host, and their words; all but words are hashes.

    Texts are read and cut once, one row per line; equal lines of a text and
    exact copies are summed before the shuffle and after it, so a text with k
    copies has k times its words, in every line alike.
    """
    cut = df.where(F.col(text).isNotNull()).select(F.col(host).alias("_host"), _document(host, text).alias("document"), F.explode(F.split(text, "\n")).alias("_line"))
    normal = cut.select("_host", "document", normal_line(F.col("_line")).alias("_normal")).where("_normal != ''")
    n = F.length("_normal") - F.length(F.translate("_normal", " ", "")) + 1
    rows = normal.select(host_hash(F.col("_host")).alias("host"), "document", line_hash(F.col("_host"), F.col("_normal")).alias("line"), n.cast("long").alias("words"))
    return stage(spark, rows.groupBy("host", "document", "line").agg(F.sum("words").alias("words")), "lines")


def frequent_lines(spark: SparkSession, lines: DataFrame, *, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(line, documents), staged: lines in more distinct documents of their host than ``max_docs`` and than ``max_share`` of those that have a line.

    A hot host is summed in parts before its documents are counted; hosts' counts are one row each.
    """
    hosts = lines.groupBy("host", "document").agg(F.first(F.lit(1)).alias("one")).groupBy("host").agg(F.sum("one").alias("_all"))
    counted = lines.groupBy("line").agg(F.first("host").alias("host"), F.count(F.lit(1)).alias("documents")).where(F.col("documents") > max_docs)
    return stage(spark, counted.join(hosts, "host").where(F.col("documents") > F.col("_all") * F.lit(float(max_share))).select("line", "documents"), "frequent")


def cut_documents(
    spark: SparkSession, df: DataFrame, host: str = "source", text: str = "text", *, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT,
) -> DataFrame:
    """(document, cut, depleted), staged: texts with frequent lines, the hashes of these, and whether less than ``min_left`` of the words is left without them.

    A line that half of all documents hold is one row on the frequent side of
    the join, whose other side adaptive execution splits.
    """
    lines = document_lines(spark, df, host, text)
    frequent = frequent_lines(spark, lines, max_docs=max_docs, max_share=max_share).select("line", F.lit(True).alias("_cut"))
    marked = lines.join(frequent, "line", "left")
    sums = marked.groupBy("document").agg(
        F.sum("words").alias("_all"), F.sum(F.when(F.col("_cut").isNull(), F.col("words"))).alias("_left"), F.collect_list(F.when(F.col("_cut"), F.col("line"))).alias("cut"),
    )
    depleted = F.coalesce("_left", F.lit(0)) < F.col("_all") * F.lit(float(min_left))
    return stage(spark, sums.where(F.size("cut") > 0).select("document", "cut", depleted.alias("depleted")), "cut")


def _without(text: Column, host: Column, cut: Column) -> Column:
    """The text without its lines whose hashes are in ``cut``; the others, blank ones included, stay as they are, in order.

    Lines and cut hashes are sorted together, a cut hash before the lines that
    have it, so the lines to go are the rest of each group that a cut hash
    begins: n log n within the row, however many lines are cut.
    """

    def of_lines(lines: Column) -> Column:
        own = F.transform(lines, lambda x, i: F.struct(line_hash(host, normal_line(x)).alias("h"), i.alias("i")))
        gone = F.transform(cut, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("i")))

        def of_sorted(s: Column) -> Column:
            first = lambda k: (k == 0) | (F.get(s, k)["h"] != F.get(s, k - 1)["h"])

            def of_starts(b: Column) -> Column:
                groups = F.transform(b, lambda k, g: F.struct(k.alias("from"), F.coalesce(F.get(b, g + 1), F.size(s)).alias("to")))
                begun = F.filter(groups, lambda x: (F.get(s, x["from"])["i"] == -1) & (x["to"] > x["from"] + 1))
                places = F.flatten(F.transform(begun, lambda x: F.transform(F.sequence(x["from"] + 1, x["to"] - 1), lambda k: F.get(s, k)["i"])))
                kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
                return let(kept, lambda left: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))

            return let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), first), of_starts)

        return let(F.sort_array(F.concat(own, gone)), of_sorted)

    return let(F.split(text, "\n"), of_lines)


def judge(spark: SparkSession, df: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """Add the statistics and ``kept``: neither failed by the base rules nor depleted.

    Rows with a null host form a host of their own.  Null, empty and wordless
    texts fail the base rules.  Repeated rows get equal verdicts.  An empty
    table stays empty.  Other columns pass through; columns named like the
    added ones are replaced.  Only depleted texts are joined, after the text
    itself is no longer needed, so no text is shuffled.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    box = sealed(df.drop(*[c for c in made if c not in (host, text)]))
    host, text = box.name(host), box.name(text)
    depleted = cut_documents(spark, box.df, host, text, **limits).where("depleted").select(F.col("document").alias("_gone"))
    joined = with_statistics(box.df.withColumn("_document", _document(host, text)), text).join(depleted, F.col("_document") == F.col("_gone"), "left")
    passed = [F.col(box.name(c)).alias(c) for c in box.names if c not in made]
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_gone").isNull()).select(*passed, *made)


def clean(spark: SparkSession, df: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The kept rows of ``df``, frequent lines removed from their text, all other columns as they were whatever their names.

    Nulls, empty texts, repeated rows and empty tables as in :func:`judge`.
    """
    box = sealed(df)
    host, text = box.name(host), box.name(text)
    found = cut_documents(spark, box.df, host, text, **limits).withColumnRenamed("document", "_gone")
    passed = with_statistics(box.df, text).where(~F.col("base_failed")).select(*box.df.columns, _document(host, text).alias("_document"))
    joined = passed.join(found, F.col("_document") == F.col("_gone"), "left").where(~F.coalesce("depleted", F.lit(False)))
    shorter = F.when(F.col("cut").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col(host), F.col("cut")))
    return box.open(joined.withColumn(text, shorter))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text,
    regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n >= 2),
rep AS (SELECT rid, COUNT(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
stat AS (
  SELECT d.rid, doc_id, source, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(COALESCE(text, '')) - length(regexp_replace(COALESCE(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
norm AS (SELECT rid, source, text, list_transform(l, lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'))) AS n FROM d),
line AS (SELECT source, text, n[i] AS line, len(string_split(n[i], ' ')) AS words FROM (SELECT source, text, n, unnest(range(1, len(n) + 1)) AS i FROM norm)),
host AS (SELECT source, COUNT(DISTINCT text) AS n FROM line WHERE line <> '' GROUP BY source),
often AS (SELECT source, line, COUNT(DISTINCT text) AS n FROM line GROUP BY source, line HAVING COUNT(DISTINCT text) > 10),
frequent AS (SELECT o.source, o.line FROM often o JOIN host h ON o.source IS NOT DISTINCT FROM h.source WHERE o.n > h.n * 0.01::DOUBLE),
depleted AS (
  SELECT l.source, l.text FROM line l LEFT JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source
  GROUP BY l.source, l.text
  HAVING SUM(CASE WHEN f.line IS NULL THEN words ELSE 0 END) < SUM(words) * 0.25::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND x.text IS NULL) AS kept
FROM stat s LEFT JOIN depleted x ON s.text = x.text AND s.source IS NOT DISTINCT FROM x.source
"""
