"""Shards by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard has ``replicas`` virtual nodes on a ring; a key belongs to the first
node clockwise of its hash.  Under the law ``rows`` a shard takes no more than
its capacity, and rows beyond it go on clockwise to the next node whose shard has
room.  The key is the text, so equal texts lie side by side and leave their shard
only where it is full.  Under the law ``key`` the key is the id, nothing
overflows, and one more shard takes rows only into itself.

Rows are not walked round the ring one by one.  They are numbered along it by one
range shuffle of narrow rows, which cuts a group of equal texts like any other;
what overflows is then a matter of counts: each arc between two nodes is split in
runs of neighbouring rows, one table row a run, in at most one round a shard.
That table has a few rows per virtual node, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.blocks import index_series
from kinetrail.plans.stage import written

POINT_BITS = 14  # the ring is looked up by so many bits of a hash
HASH_BITS = 60
LAWS = ("rows", "key")


def _hash(key: Column) -> Column:
    """The first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _point(place: Column) -> Column:
    return F.shiftright(place, HASH_BITS - POINT_BITS)


def ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """(arc, shard, point) of the virtual nodes, numbered clockwise; of nodes at one point the least hash stays."""
    node = spark.range(0, shards * replicas, 1, 1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    placed = node.withColumn("place", _hash(F.concat_ws(":", F.lit("ring"), "shard", "replica").cast("binary")))
    one = placed.groupBy(_point(F.col("place")).alias("point")).agg(F.min(F.struct("place", "shard")).alias("v"))
    return one.select((F.row_number().over(W.orderBy("point")) - 1).alias("arc"), F.col("v.shard").alias("shard"), "point")


def owners(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(point, arc, shard) of all points of the ring: the first node at or after each."""
    ahead = W.orderBy(F.desc("point")).rowsBetween(W.unboundedPreceding, W.currentRow)
    node = F.struct("arc", "shard")
    found = spark.range(0, 1 << POINT_BITS, 1, 1).withColumnRenamed("id", "point").join(nodes, "point", "left").select(
        "point", F.last(F.when(F.col("arc").isNotNull(), node), ignorenulls=True).over(ahead).alias("v"),
        F.min(F.when(F.col("arc").isNotNull(), node)).over(W.partitionBy()).alias("first"))
    return found.select("point", F.coalesce("v.arc", "first.arc").alias("arc"), F.coalesce("v.shard", "first.shard").alias("shard"))


def _clockwise(runs: DataFrame, nodes: DataFrame, capacity: DataFrame) -> DataFrame:
    """One round: shards take of the runs that wait at their nodes what they have room for, in the order
    of the ring; the rest wait at the next node whose shard has room left."""
    rows = F.col("hi") - F.col("lo")
    free = capacity.join(runs.filter("done").groupBy("shard").agg(F.sum(rows).alias("used")), "shard", "left").select(
        "shard", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("free"))
    earlier = W.partitionBy("shard").orderBy("arc", "lo").rowsBetween(W.unboundedPreceding, -1)
    waiting = runs.filter("not done").join(free, "shard").withColumn("cut", F.col("lo") + F.greatest(
        F.lit(0), F.least(rows, F.col("free") - F.coalesce(F.sum(rows).over(earlier), F.lit(0)))))
    left = free.join(waiting.groupBy("shard").agg(F.sum(F.col("cut") - F.col("lo")).alias("taken")), "shard", "left").filter(
        F.col("free") > F.coalesce("taken", F.lit(0))).select("shard")
    after = W.orderBy("arc").rowsBetween(1, W.unboundedFollowing)
    node = F.when(F.col("open"), F.struct("arc", "shard"))
    onward = nodes.join(left.withColumn("open", F.lit(True)), "shard", "left").select(
        F.col("arc").alias("at"), F.coalesce(F.min(node).over(after), F.min(node).over(W.partitionBy())).alias("to"))
    taken = waiting.filter("cut > lo").select("arc", "lo", F.col("cut").alias("hi"), "at", "shard", F.lit(True).alias("done"))
    rest = waiting.filter("hi > cut").select("arc", F.col("cut").alias("lo"), "hi", "at").join(onward, "at").select(
        "arc", "lo", "hi", F.col("to.arc").alias("at"), F.col("to.shard").alias("shard"), F.lit(False).alias("done"))
    return runs.filter("done").unionByName(taken).unionByName(rest)


def place_rows(counts: DataFrame, nodes: DataFrame, capacity: DataFrame | None) -> DataFrame:
    """(arc, lo, hi, shard) from (arc, n): which rows of an arc, by their number, lie in which shard.

    Without ``capacity`` (shard, capacity) all stay in their arc's shard.  The
    capacities must hold all rows.  A round that leaves rows over has filled a
    shard, so there are no more rounds than shards.  The tables of a round have
    some rows a virtual node: as one partition each they need no exchange.
    """
    runs = counts.join(nodes, "arc").select(
        "arc", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.col("arc").alias("at"), "shard",
        F.lit(capacity is None).alias("done"))
    runs = written(runs, "runs").coalesce(1)
    while not runs.filter("not done").isEmpty():
        runs = written(_clockwise(runs, nodes, capacity), "runs").coalesce(1)
    return runs.select("arc", "lo", "hi", "shard")


def shard(docs: DataFrame, shards: int = 8, law: str = "rows", replicas: int = 64, slack: float = 0.0,
          keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *keep) of every document.

    ``size`` is the text's UTF-8 bytes plus 1.  ``rows``: a shard holds at most
    ``1 + slack`` times its share; without slack counts are at most one apart.
    ``key``: a row's shard depends on its id and the number of shards only, and
    ``grown_shard`` is its shard were there one more.  ``slot`` numbers the rows
    of a shard from 0 along the ring.

    A null text counts as empty; a null id is an id like others, written as no
    digits; repeated rows are rows of their own with slots of their own; an empty
    table gives no rows; of other columns only those in ``keep`` are carried.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}, not {law!r}")
    spark = docs.sparkSession
    nodes = written(ring(spark, shards, replicas), "ring").coalesce(1)
    of_point = owners(spark, nodes).select("point", "arc")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = raw if law == "rows" else F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)  # one column: no clash with ours
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        _hash(key).alias("place"), F.monotonically_increasing_id().alias("row"), carried.alias("own")).withColumn("point", _point(F.col("place")))
    grown = F.lit(None).cast("int")
    if law == "key":
        more = owners(spark, ring(spark, shards + 1, replicas)).select("point", F.col("shard").alias("grown_shard"))
        of_point, grown = of_point.join(more, "point"), F.col("grown_shard")
    # 2 ** POINT_BITS rows
    base = base.join(F.broadcast(of_point), "point").withColumn("grown_shard", grown).drop("point")
    # a third of all rows may have one text or one id: the row's own number lets the range shuffle cut them
    lined = index_series(written(base, "lined"), ["arc"], ["place", "doc_id", "row"])
    counts = lined.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    capacity = None
    if law == "rows":
        n = docs.count()
        most = -(-int(n * (1 + slack) * 1_000_000) // (1_000_000 * shards)) if slack else None
        capacity = spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"), (
            F.lit(most) if slack else F.lit(n // shards) + (F.col("id") < n % shards).cast("long")).cast("long").alias("capacity"))
    runs = place_rows(counts, nodes, capacity)
    earlier = W.partitionBy("shard").orderBy("arc", "lo").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("first", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(earlier), F.lit(0)))
    # one row an arc, at most a run a shard and one more
    of_arc = runs.groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "first")).alias("runs"))
    i = F.col("i")
    run = F.filter("runs", lambda r: (r["lo"] <= i) & (i < r["hi"]))[0]
    return lined.join(F.broadcast(of_arc), "arc").withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.first") + i - F.col("run.lo")).alias("slot"), "grown_shard", *[F.col("own").getField(c).alias(c) for c in keep])


def sql(shards: int = 8, replicas: int = 64) -> str:
    """The law ``rows`` without slack in DuckDB, over table ``documents`` (whose ids must differ)."""
    rounds = []
    for k in range(shards):
        rounds.append(f"""
  free{k} AS (SELECT shard, capacity - coalesce((SELECT sum(hi - lo) FROM runs{k} r WHERE done AND r.shard = c.shard), 0) AS free FROM capacity c),
  waiting{k} AS (SELECT r.*, lo + greatest(0, least(hi - lo, free - coalesce(sum(hi - lo) OVER (PARTITION BY shard ORDER BY arc, lo
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS cut FROM runs{k} r JOIN free{k} USING (shard) WHERE NOT done),
  left{k} AS (SELECT shard FROM free{k} f WHERE free > coalesce((SELECT sum(cut - lo) FROM waiting{k} w WHERE w.shard = f.shard), 0)),
  open{k} AS (SELECT n.arc, n.shard, n.shard IN (SELECT shard FROM left{k}) AS open FROM nodes n),
  onward{k} AS (SELECT arc AS here, coalesce(min(CASE WHEN open THEN arc END) OVER (ORDER BY arc ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
      min(CASE WHEN open THEN arc END) OVER ()) AS next_at FROM open{k}),
  runs{k + 1} AS (
    SELECT * FROM runs{k} WHERE done
    UNION ALL SELECT arc, lo, cut AS hi, here, shard, true AS done FROM waiting{k} WHERE cut > lo
    UNION ALL SELECT w.arc, w.cut, w.hi, o.next_at, n.shard, false FROM waiting{k} w JOIN onward{k} o USING (here) JOIN nodes n ON n.arc = o.next_at
      WHERE w.hi > w.cut),""")
    shift = HASH_BITS - POINT_BITS
    return f"""WITH placed AS (
    SELECT s AS shard, ('0x' || substr(md5('ring:' || s || ':' || r), 1, 15))::BIGINT AS place
    FROM range({shards}) t(s), range({replicas}) u(r)),
  nodes AS (
    SELECT (row_number() OVER (ORDER BY point) - 1)::BIGINT AS arc, shard, point FROM (
      SELECT place >> {shift} AS point, arg_min(shard, place) AS shard FROM placed GROUP BY ALL)),
  rows_of AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS place
    FROM documents),
  on_arc AS (
    SELECT r.*, coalesce(n.arc, 0) AS arc FROM rows_of r ASOF LEFT JOIN nodes n ON (r.place >> {shift}) <= n.point),
  lined AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id) - 1 AS i FROM on_arc),
  capacity AS (SELECT s AS shard, (SELECT count(*) FROM documents) // {shards} + (s < (SELECT count(*) FROM documents) % {shards})::BIGINT AS capacity
    FROM range({shards}) t(s)),
  runs0 AS (SELECT arc, 0::BIGINT AS lo, count(*) AS hi, arc AS here, any_value(shard) AS shard, false AS done FROM lined JOIN nodes USING (arc) GROUP BY arc),
  {"".join(rounds).strip()}
  firsts AS (SELECT *, coalesce(sum(hi - lo) OVER (PARTITION BY shard ORDER BY arc, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM runs{shards}),
  crc_table AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM range(256) x(b)),
  crc AS (
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM rows_of, crc_table)
  SELECT l.doc_id, l.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'rows' AS law, f.shard::INTEGER AS shard,
    (f.first + l.i - f.lo)::BIGINT AS slot, NULL::INTEGER AS grown_shard
  FROM lined l JOIN firsts f ON l.arc = f.arc AND l.i >= f.lo AND l.i < f.hi JOIN crc c USING (doc_id)"""
