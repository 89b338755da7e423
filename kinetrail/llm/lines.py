"""Line dedup by content-defined chunks of lines (DataFrame functions only).

Two neighbouring lines are an anchor where a rolling hash over their hashes is 0
modulo ``cut``, or where they are long together.  That depends on the two lines
alone, so an insertion elsewhere does not shift it.  Every line opens a chunk that
ends with the first anchor behind it and closes one that begins with the last
anchor before it, so a passage that holds an anchor is covered by chunks of its
own lines, whatever stands around it.  Chunks of two lines or more that occur more
than once anywhere are found by hash, then compared by their bytes; the first
occurrence stays.  Blank lines belong to the line before them and are not compared.

Texts are moved once, into a table bucketed by row.  Chunking stays inside a row;
only hashes are counted over the whole corpus, and only chunks whose hash repeats
are shuffled with their text, once.  A hash in a third of all documents is counted
by partial aggregates and dealt to groups of bounded size; only the groups' firsts
meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.plans.stage import fresh_path, written

CUT = 2
MIX = 7  # weight of the line before in the rolling hash
LONG = 120  # characters of two neighbouring lines that make them an anchor whatever their hash
GROUP = 512  # about so many chunks of one hash are compared in one group
MOST = 16  # lines of a chunk at most: without an anchor it ends there


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bucketed(df: DataFrame, key: str, make) -> DataFrame:
    """``make(df)`` as a table in the shared folder, bucketed by ``key``: joins on it move no text again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "chunks")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), "chunks_" + path.rsplit("-", 1)[1]
    make(df.repartition(n, key)).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(
        name, format="parquet")
    return spark.table(name)


def _solid(line: Column) -> Column:
    return line.rlike("[^ \\t\\r]")


def _body(lines: Column) -> Column:
    return F.array_join(F.filter(lines, _solid), "\n")


def _chunks(lines: Column, cut: int, long: int, most: int) -> Column:
    """Array of (h, start, stop): the chunks' hashes and their places among the lines."""

    def anchors(solid: Column) -> Column:
        """For each line but the last, whether it and the next are an anchor."""
        hashed = F.transform(solid, lambda x: F.struct(
            F.conv(F.substring(F.md5(x["line"].cast("binary")), 1, 7), 16, 10).cast("long").alias("h"),
            F.length(x["line"]).alias("n")))
        return _let(hashed, lambda hs: F.zip_with(
            F.slice(hs, 1, F.greatest(F.size(hs) - 1, F.lit(0))), F.slice(hs, 2, F.size(hs)),
            lambda a, b: ((b["h"] + MIX * a["h"]) % cut == 0) | (a["n"] + b["n"] >= long)))

    def spans(n: Column, flags: Column) -> Column:
        def ahead(i: Column) -> Column:  # stop of the chunk that line i opens
            return _let(F.array_position(F.slice(flags, i + 1, F.lit(most - 1)), True).cast("int"), lambda p: F.struct(
                i.alias("a"), F.when(p > 0, i + p + 1).otherwise(F.least(i + most, n)).alias("b")))

        def back(j: Column) -> Column:  # start of the chunk that line j closes; an anchor's own pair is known from ahead
            first = F.greatest(j - (most - 1), F.lit(0))
            return _let(F.array_position(F.reverse(F.slice(flags, first + 1, j - first)), True).cast("int"), lambda p: F.struct(
                F.when(p > 0, j - p).otherwise(first).alias("a"), F.when(p != 1, j + 1).alias("b")))

        return F.concat(F.transform(F.sequence(F.lit(0), n - 2), ahead),
                        F.filter(F.transform(F.sequence(F.lit(1), n - 1), back), lambda s: s["b"].isNotNull()))

    def all_of(solid: Column) -> Column:
        """``solid``: (line, number) of every line that is not blank."""
        def at(u: Column) -> Column:  # line number of solid line u; behind the last, the number of lines
            return F.when(u < F.size(solid), F.get(solid, u)["i"]).otherwise(F.size(lines))

        found = _let(anchors(solid), lambda flags: spans(F.size(solid), flags))
        return F.when(F.size(solid) > 1, F.transform(found, lambda s: F.struct(
            F.xxhash64(F.array_join(F.transform(F.slice(solid, s["a"] + 1, s["b"] - s["a"]), lambda x: x["line"]), "\n")).alias("h"),
            at(s["a"]).alias("start"), at(s["b"]).alias("stop"))))

    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    return _let(F.filter(numbered, lambda x: _solid(x["line"])), all_of)


def dedup_lines(docs: DataFrame, cut: int = CUT, long: int = LONG, most: int = MOST, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents with later occurrences of repeated chunks removed.

    Occurrences are ordered by (id, place); a null id comes first, and rows that
    share an id follow the order they are stored in.  Chunks may overlap: a removed
    line always remains at an earlier place, and a line repeated many times in a
    row stays once.  A removed line takes the blank lines behind it along; blank
    lines alone never go.  A null text stays null; an empty text is one blank line
    and stays; a document of removed chunks only becomes empty; repeated rows are
    documents of their own, so the later copy loses its repeated chunks; an empty
    table gives no rows.  All columns are kept; ``_n_removed`` (lines removed,
    blank ones included) is added.

    Rows are numbered before they are dealt to buckets, so a repeated task must read
    its rows in the same order: pass a table, as the query and the pipeline do.
    """
    own = F.struct(*[F.col(c) for c in docs.columns if c != text_col])  # one column: no clash with ours
    base = _bucketed(docs.select(
        own.alias("own"), F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.split(F.col(text_col), "\n", -1).alias("lines")), "rid", lambda df: df.withColumn(
            "chunks", _chunks(F.col("lines"), cut, long, most)))
    repeated = base.select(F.explode("chunks.h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = base.select("rid", F.explode("chunks").alias("c")).select("rid", "c.*")
    # a hash of very many chunks is dealt to several groups
    share = F.pmod(F.xxhash64("rid", "start"), F.floor(F.col("n") / GROUP) + 1)
    # a set: in a text without an anchor a chunk may be both opened and closed
    wanted = places.join(repeated, "h").groupBy("rid").agg(F.collect_set(F.struct(
        "h", share.alias("share"), (F.col("n") >= GROUP).alias("hot"), "start", "stop")).alias("spans"))
    bodies = F.transform("spans", lambda s: F.struct(
        s.alias("s"), _body(F.slice("lines", s["start"] + 1, s["stop"] - s["start"])).alias("body")))
    candidates = base.select("id", "rid", "lines").join(wanted, "rid").select(
        "id", "rid", F.explode(bodies).alias("c")).select("id", "rid", "c.s.*", "c.body")
    # equal bytes are ranked in their group; only the first of a group of a hot hash has to meet the other groups' firsts
    place = F.row_number().over(Window.partitionBy("h", "share", "body").orderBy("id", "rid", "start"))
    ranked = written(candidates.withColumn("_place", place).withColumn(
        "body", F.when(F.col("hot") & (F.col("_place") == 1), F.col("body"))), "candidates")
    among = F.row_number().over(Window.partitionBy("h", "body").orderBy("id", "rid", "start"))
    firsts = ranked.filter("hot and _place = 1").withColumn("_among", among).filter("_among > 1")
    later = ranked.filter("_place > 1").select("rid", "start", "stop").unionAll(firsts.select("rid", "start", "stop"))
    # overlapping and touching spans of a document become one
    so_far = Window.partitionBy("rid").orderBy("start", "stop")
    opens = (F.col("start") > F.max("stop").over(so_far.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    runs = later.withColumn("_opens", F.coalesce(opens, F.lit(1))).withColumn("run", F.sum("_opens").over(
        so_far.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    gone = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    joined = base.drop("chunks").join(gone, "rid", "left")
    kept = F.zip_with(F.concat(F.array(F.lit(0)), F.col("gone.stop")), F.concat(F.col("gone.start"), F.array(F.size("lines"))),
                      lambda a, b: F.slice("lines", a + 1, b - a))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(kept)), "\n")
    removed = F.aggregate("gone", F.lit(0), lambda s, g: s + g["stop"] - g["start"])
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns],
        F.coalesce(removed, F.lit(0)).alias("_n_removed"))


#: The same in DuckDB, over table ``documents``: CTE ``deduped`` (doc_id, text, n_removed).
SQL_CTES = f"""lines AS (
    SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line,
      unnest(range(len(string_split(text, chr(10))))) AS i FROM {{docs}}),
  solid AS (
    SELECT doc_id, line, i, row_number() OVER w - 1 AS u, coalesce(lead(i) OVER w, n) AS after,
      ('0x' || substr(md5(line), 1, 7))::BIGINT AS h
    FROM lines WHERE regexp_matches(line, '[^ \t\r]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  flagged AS (
    SELECT *, (lead(h) OVER w + {MIX} * h) % {CUT} = 0 OR length(line) + lead(length(line)) OVER w >= {LONG} AS anchor,
      count(*) OVER (PARTITION BY doc_id) AS nu FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
  near AS (
    SELECT doc_id, u, nu, min(CASE WHEN anchor THEN u END) OVER (
        PARTITION BY doc_id ORDER BY u ROWS BETWEEN CURRENT ROW AND {MOST - 2} FOLLOWING) AS ahead,
      max(CASE WHEN anchor THEN u END) OVER (
        PARTITION BY doc_id ORDER BY u ROWS BETWEEN {MOST - 1} PRECEDING AND 1 PRECEDING) AS back FROM flagged),
  spans AS (
    SELECT doc_id, u AS a, coalesce(ahead + 2, least(u + {MOST}, nu)) AS b FROM near WHERE u < nu - 1
    UNION SELECT doc_id, coalesce(back, greatest(u - {MOST - 1}, 0)), u + 1 FROM near WHERE u > 0),
  listed AS (
    SELECT doc_id, list(line ORDER BY u) AS solid_lines, list(i ORDER BY u) AS starts, list(after ORDER BY u) AS stops
    FROM solid GROUP BY doc_id),
  bodies AS (
    SELECT doc_id, a, starts[a + 1] AS start, stops[b] AS stop, array_to_string(solid_lines[a + 1:b], chr(10)) AS body
    FROM spans JOIN listed USING (doc_id)),
  marked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) > 1 AS gone FROM bodies),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS i, true AS gone FROM marked WHERE gone),
  deduped AS (
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(m.body, '') END AS text, coalesce(m.n_removed, 0) AS n_removed
    FROM {{docs}} d LEFT JOIN (
      SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL) AS body,
        (count(*) FILTER (WHERE gone))::INTEGER AS n_removed FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id) m USING (doc_id))"""
