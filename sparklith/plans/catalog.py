"""Every registered query with the SQL that it must agree with.

Positions come from ``orders`` by ``o_orderkey``, which is unique. NULLs are injected with ``nullif``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklith.functions import expressions as X
from sparklith.functions.hashing import bucket_id, row_hash
from sparklith.functions.registry import Signature, default_registry
from sparklith.functions.validity import both_valid, either_valid, is_valid, same_validity, with_validity
from sparklith.operators import joins, partitioning, positional, prefix
from sparklith.sources import column, described, named, slice_rows, strings, table, take, view, write_table
from sparklith.sources.shared import Workspace

from .sql import expression_type, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Scalar kernels over lineitem.
_ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_linenumber as smallint) as n16, cast(l_linenumber as tinyint) as n8, l_partkey = l_suppkey as same, nullif(l_partkey, l_suppkey) as part_or_null, l_returnflag, l_linestatus"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(l_linenumber as smallint) as n16", "cast(l_linenumber as tinyint) as n8",
        "l_partkey = l_suppkey as same", "nullif(l_partkey, l_suppkey) as part_or_null", "l_returnflag", "l_linestatus",
    )


def _scalar(name: str, build: Callable[[DataFrame], F.Column], sql: str) -> None:
    @query(name, f"select l_orderkey as k, {sql} as out from (select {_ITEM} from lineitem)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = items(spark, sf_dir)
        return df.select(F.col("l_orderkey").alias("k"), build(df).alias("out"))


_scalar("add_u64_u64", lambda d: X.add(d, "l_orderkey", "l_partkey"), "l_orderkey + l_partkey")
_scalar("add_u64_u32", lambda d: X.add(d, "l_orderkey", "l_linenumber"), "l_orderkey + l_linenumber")
_scalar("add_u64_u16", lambda d: X.add(d, "l_orderkey", "n16"), "l_orderkey + n16")
_scalar("add_u64_u8", lambda d: X.add(d, "l_orderkey", "n8"), "l_orderkey + n8")
_scalar("add_u64_bool", lambda d: X.add(d, "l_orderkey", "same"), "l_orderkey + cast(same as bigint)")
_scalar("add_u32_u32", lambda d: X.add(d, "l_linenumber", "l_linenumber"), "l_linenumber + l_linenumber")
_scalar("add_null", lambda d: X.add(d, "part_or_null", "l_orderkey"), "part_or_null + l_orderkey")
_scalar("add_try", lambda d: X.add(d, "l_orderkey", "l_partkey", overflow="null"), "l_orderkey + l_partkey")
_scalar("add_constant", lambda d: X.add(d, "l_orderkey", X.constant(7)), "l_orderkey + 7")
_scalar("eq_num", lambda d: X.eq(d, "l_partkey", "l_suppkey"), "l_partkey = l_suppkey")
_scalar("eq_u64_bool", lambda d: X.eq(d, "l_linenumber", "same"), "l_linenumber = cast(same as bigint)")
_scalar("eq_str", lambda d: X.eq(d, "l_returnflag", "l_linestatus"), "l_returnflag = l_linestatus")
_scalar("eq_null", lambda d: X.eq(d, "part_or_null", "l_suppkey"), "part_or_null = l_suppkey")
_scalar("eq_u64_u32", lambda d: X.eq(d, "l_suppkey", "l_linenumber"), "l_suppkey = l_linenumber")
_scalar("eq_u64_u16", lambda d: X.eq(d, "l_suppkey", "n16"), "l_suppkey = n16")
_scalar("eq_u64_u8", lambda d: X.eq(d, "l_suppkey", "n8"), "l_suppkey = n8")
_scalar("eq_u32_u32", lambda d: X.eq(d, "l_linenumber", F.pmod(F.col("l_orderkey"), F.lit(8)).cast("int")), "l_linenumber = l_orderkey % 8")
for _op, _build, _sign in (("gt", X.gt, ">"), ("ge", X.ge, ">=")):
    _scalar(f"{_op}_u64_u32", lambda d, f=_build: f(d, "l_suppkey", "l_linenumber"), f"l_suppkey {_sign} l_linenumber")
    _scalar(f"{_op}_u64_u16", lambda d, f=_build: f(d, "l_suppkey", "n16"), f"l_suppkey {_sign} n16")
    _scalar(f"{_op}_u64_u8", lambda d, f=_build: f(d, "l_suppkey", "n8"), f"l_suppkey {_sign} n8")
    _scalar(f"{_op}_u64_bool", lambda d, f=_build: f(d, "l_linenumber", "same"), f"l_linenumber {_sign} cast(same as bigint)")
    _scalar(f"{_op}_u32_u32", lambda d, f=_build: f(d, "l_linenumber", "l_linenumber"), f"l_linenumber {_sign} l_linenumber")


def _kernel(name: str, *roles: str) -> Callable[..., F.Column]:
    """A registered kernel, to be applied to columns."""
    return lambda *columns: default_registry().apply(name, list(columns), list(roles))[0]


for _name, _sign in (("add", "+"), ("eq", "="), ("gt", ">"), ("ge", ">=")):
    _scalar(f"{_name}_usize_usize", lambda d, k=_kernel(_sign, "usize", "usize"): k(F.col("l_partkey"), F.col("l_suppkey")), f"l_partkey {_sign} l_suppkey")
_scalar("gt_num", lambda d: X.gt(d, "l_partkey", "l_suppkey"), "l_partkey > l_suppkey")
_scalar("gt_null", lambda d: X.gt(d, "part_or_null", "l_linenumber"), "part_or_null > l_linenumber")
_scalar("ge_num", lambda d: X.ge(d, "l_partkey", "l_suppkey"), "l_partkey >= l_suppkey")
_scalar("ge_null", lambda d: X.ge(d, "part_or_null", "l_linenumber"), "part_or_null >= l_linenumber")
_scalar("validity_attach", lambda d: with_validity(F.col("l_partkey"), F.col("n8") - 1), "case when n8 <> 1 then l_partkey end")
_scalar("validity_and", lambda d: both_valid(F.col("part_or_null"), F.col("l_orderkey")), "part_or_null is not null and l_orderkey is not null")
_scalar("validity_or", lambda d: either_valid(F.col("part_or_null"), F.col("l_orderkey")), "part_or_null is not null or l_orderkey is not null")
_scalar("validity_is_set", lambda d: is_valid(F.col("part_or_null")), "part_or_null is not null")


# SQL projections.
def _projection(name: str, text: str, sql: str, strict: bool = True) -> None:
    @query(name, f"select {sql} as out from (select {_ITEM} from lineitem)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(items(spark, sf_dir), text, strict=strict)


_projection("add_chain", "(l_orderkey + l_linenumber) + l_suppkey", "(l_orderkey + l_linenumber) + l_suppkey")
_projection("sql_eq", "SELECT l_partkey = l_suppkey", "l_partkey = l_suppkey")
_projection("sql_gt", "l_partkey > l_suppkey", "l_partkey > l_suppkey")
_projection("ge_expr_right", "l_orderkey >= (l_partkey + l_suppkey)", "l_orderkey >= l_partkey + l_suppkey")
_projection("add_eq_nested", "l_orderkey + (l_partkey = l_suppkey)", "l_orderkey + cast(l_partkey = l_suppkey as bigint)")
_projection("sql_expression_both_sides", "(l_orderkey + l_partkey) - (l_suppkey * 2)", "(l_orderkey + l_partkey) - (l_suppkey * 2)", strict=False)
_projection("sql_expression_left", "(l_orderkey + l_partkey) >= l_suppkey", "(l_orderkey + l_partkey) >= l_suppkey", strict=False)


@query("udf_kernel", f"select l_orderkey - l_partkey as out from (select {_ITEM} from lineitem)")
def udf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel that the user registers under ``-`` is reachable from strict expressions."""
    registry = default_registry()
    registry.register(Signature.of("-", "u64", "u64"), lambda a, b: a - b, "u64")
    return project(items(spark, sf_dir), "l_orderkey - l_partkey", strict=True, registry=registry)


_TYPED = {"l_orderkey + l_partkey": "u64", "l_linenumber + l_linenumber": "u32", "l_orderkey >= l_linenumber": "bool", "l_returnflag = l_linestatus": "bool", "(l_orderkey + l_linenumber) + l_suppkey": "u64"}


@query("expression_types", " union all ".join(f"select '{e}' as expression, '{r}' as role" for e, r in _TYPED.items()))
def expression_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of strict expressions, found without running them."""
    df = items(spark, sf_dir)
    return spark.createDataFrame([(e, expression_type(df, e)) for e in _TYPED], "expression string, role string")


# Sources and sinks.
@query("source_memory", "select i as pos, i * i as value from (select unnest(range(1000)) as i)")
def source_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column(spark, [i * i for i in range(1000)])


@query("source_memory_null", "select i as pos, case when i % 3 <> 0 then i end as value from (select unnest(range(1000)) as i)")
def source_memory_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column(spark, range(1000), valid=[i % 3 for i in range(1000)])


@query("source_strings", "select i as pos, repeat('ab', cast(i % 8 as integer)) as value from (select unnest(range(1000)) as i)")
def source_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, ["ab" * (i % 8) for i in range(1000)])


@query("source_view", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that SQL knows by name."""
    view(table(spark, sf_dir, "nation"), "known_nation"), view(table(spark, sf_dir, "region"), "known_region")
    return spark.sql("select n_name, r_name from known_nation join known_region on n_regionkey = r_regionkey")


@query("named_column", "select o_orderkey as key_of_order from orders")
def named_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(table(spark, sf_dir, "orders"), "o_orderkey", "key_of_order").select("key_of_order")


@query("described_columns", "with x as (select count(*) as n, count(nullif(l_partkey, l_suppkey)) as v from lineitem) select 'l_orderkey' as name, 'u64' as role, false as indexed, n, n as valid from x union all select 'part_or_null', 'u64', false, n, v from x union all select 'n16', 'u16', false, n, n from x union all select 'l_returnflag', 'str', false, n, n from x")
def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, role, index and validity of columns."""
    return described(items(spark, sf_dir), ["l_orderkey", "part_or_null", "n16", "l_returnflag"])


@query("sink_roundtrip", "select o_orderkey, o_orderstatus, o_custkey % 16 as bucket from orders")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in a folder a bucket, and read again."""
    path = Workspace(spark, "sink").path
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", bucket_id("o_custkey", 4).alias("bucket"))
    write_table(df, path, "bucket")
    return spark.read.schema(df.schema).parquet(path)


@query("sink_take", "select cast(n_nationkey as bigint) as pos, n_name as value from nation")
def sink_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column's values in order, taken with its role, on the driver; here as a column again."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("pos"), "n_name")
    return strings(spark, take(df, "n_name", "str"))


# Positions.
def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


_POS = "select o_orderkey, o_custkey, o_totalprice, o_orderstatus, row_number() over (order by o_orderkey) - 1 as pos from orders"


@query("positions", f"select o_orderkey, pos from ({_POS})")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir).select("o_orderkey", "pos")


@query("positions_sparse", "select hash_key, row_number() over (order by hash_key) - 1 as pos from (select cast(o_orderkey * 7046029254386353 % 1152921504606846883 as bigint) as hash_key from (select cast(o_orderkey as hugeint) as o_orderkey from orders))")
def positions_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by keys that are spread over 2**60."""
    key = (F.col("o_orderkey").cast("decimal(20,0)") * F.lit("7046029254386353").cast("decimal(17,0)")) % F.lit("1152921504606846883").cast("decimal(20,0)")
    return positional.with_position(table(spark, sf_dir, "orders").select(key.cast("bigint").alias("hash_key")), "hash_key")


@query("positions_of_strings", "select c_name, row_number() over (order by c_name) - 1 as pos from customer")
def positions_of_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.with_position(table(spark, sf_dir, "customer").select("c_name"), "c_name")


@query("positions_in_ranges", f"select o_orderkey, pos from ({_POS})")
def positions_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as they are found in a table of many ranges."""
    return prefix.row_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", chunk=4096)


@query("slice", f"select o_orderkey, pos - 100 as pos from ({_POS}) where pos >= 100 and pos < 1000")
def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_rows(positioned(spark, sf_dir), 100, 1000).select("o_orderkey", "pos")


def _reversed_index(df: DataFrame) -> DataFrame:
    """pos -> pos / 2: every position twice, the later half never."""
    return df.select("pos", F.floor(F.col("pos") / 2).cast("bigint").alias("at"))


@query("gather", f"with p as ({_POS}) select i.pos, d.o_orderkey from p i join p d on d.pos = i.pos // 2")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = positioned(spark, sf_dir)
    return positional.gather(df.select("pos", "o_orderkey"), _reversed_index(df))


@query("re_index", f"with p as ({_POS}) select i.pos, d.o_orderkey from p i join p d on d.pos = (i.pos // 2) // 2")
def re_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = positioned(spark, sf_dir)
    index = _reversed_index(df)
    twice = positional.re_index(index, index)
    return positional.gather(df.select("pos", "o_orderkey"), twice)


@query("aligned_zip", f"with p as ({_POS}) select pos, o_orderkey, o_custkey from p")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = positioned(spark, sf_dir)
    return positional.aligned_zip(df.select("pos", "o_orderkey"), df.select("pos", "o_custkey"))


@query("len_data", "select count(*) as n from orders")
def len_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.length(table(spark, sf_dir, "orders"))


@query("len_logical", "select 2 * count(*) as n from orders")
def len_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a column is that of its index: here every position stands twice in it."""
    df = positioned(spark, sf_dir)
    twice = df.select(F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).alias("pos"), F.col("pos").alias("at"))
    return positional.length(positional.gather(df.select("pos", "o_orderkey"), twice))


# Joins.
@query("join_inner_dup", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey")
def join_inner_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return joins.spread_join(c, s, [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


@query("join_null_keys", "select c_custkey, s_suppkey from (select *, nullif(c_nationkey, 3) as ck from customer) join (select *, nullif(s_nationkey, 5) as sk from supplier) on ck = sk")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("ck", F.expr("nullif(c_nationkey, 3)"))
    s = table(spark, sf_dir, "supplier").withColumn("sk", F.expr("nullif(s_nationkey, 5)"))
    return joins.spread_join(c, s, [("ck", "sk")]).select("c_custkey", "s_suppkey")


@query("join_residual_ge", "select l_orderkey, l_partkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey and l_partkey >= o_custkey")
def join_residual_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return joins.hash_join(l, o, [("l_orderkey", "o_orderkey")], "l_partkey >= o_custkey").select("l_orderkey", "l_partkey", "o_custkey")


@query("join_residual_gt", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey > s_suppkey")
def join_residual_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return joins.spread_join(c, s, [("c_nationkey", "s_nationkey")], "c_custkey > s_suppkey").select("c_custkey", "s_suppkey")


@query("join_string_key", "with a as (select p_brand, count(*) as n from part group by 1), b as (select p_brand as brand, max(p_size) as size from part group by 1) select p_brand, n, size from a join b on p_brand = brand")
def join_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), p.groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_size").alias("size"))
    return joins.hash_join(a, b, [("p_brand", "brand")]).select("p_brand", "n", "size")


@query("join_empty", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey where s_suppkey < 0")
def join_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier").where("s_suppkey < 0")
    return joins.hash_join(c, s, [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


@query("join_shuffle_hash", "select l_orderkey, l_suppkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def join_shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return joins.hash_join(o, l, [("o_orderkey", "l_orderkey")], hint="shuffle_hash").select("l_orderkey", "l_suppkey", "o_custkey")


@query("join_bucketed", "select l_orderkey, l_partkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey and l_partkey >= o_custkey")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides in 2**6 partitions by their keys, and a join inside each with the residual."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return joins.bucketed_join(l, o, [("l_orderkey", "o_orderkey")], 6, "l_partkey >= o_custkey").select("l_orderkey", "l_partkey", "o_custkey")


@query("join_index_pairs", f"with p as ({_POS}), c as (select c_custkey, row_number() over (order by c_custkey) - 1 as cpos from customer) select pos as left_pos, cpos as right_pos from p join c on o_custkey = c_custkey")
def join_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = positioned(spark, sf_dir)
    c = positional.with_position(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return joins.index_pairs(o, c, "o_custkey", "c_custkey")


@query("join_even_hashes", f"with p as ({_POS}), c as (select c_custkey, row_number() over (order by c_custkey) - 1 as cpos from customer) select pos as left_pos, cpos as right_pos from p join c on o_custkey = c_custkey and o_custkey % 2 = 0")
def join_even_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that mark NULL by being odd; here the key is its own hash."""
    c = positional.with_position(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return joins.even_hash_pairs(positioned(spark, sf_dir), c, "o_custkey", "c_custkey")


@query("filter_pairs", f"with p as ({_POS}), c as (select c_custkey, c_acctbal, row_number() over (order by c_custkey) - 1 as cpos from customer) select pos as left_pos, cpos as right_pos from p join c on o_custkey = c_custkey where o_totalprice >= c_acctbal * 10")
def filter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = positioned(spark, sf_dir)
    c = positional.with_position(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    pairs = joins.index_pairs(o, c, "o_custkey", "c_custkey")
    return joins.filter_pairs(pairs, o.select("pos", "o_totalprice"), c.select("pos", "c_acctbal"), "o_totalprice >= c_acctbal * 10")


# Buckets and partitions; the bucket of a key is here the key itself modulo 64, which SQL has, too.
@query("bucket_id", "select l_orderkey, l_orderkey % 64 as bucket from lineitem")
def bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", bucket_id("l_orderkey", 6).alias("bucket"))


@query("bucket_null", "select l_orderkey, coalesce(nullif(l_partkey, l_suppkey) % 64, 63) as bucket from lineitem")
def bucket_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("l_orderkey", bucket_id("part_or_null", 6).alias("bucket"))


_BUCKETS = f"select *, o_custkey % 16 as bucket, pos // 1000 as chunk from ({_POS})"
_GRID = f"with b as ({_BUCKETS}), g as (select c as chunk, k as bucket from (select distinct chunk as c from b), (select unnest(range(16)) as k)), n as (select g.chunk, g.bucket, count(b.pos) as n from g left join b on b.chunk = g.chunk and b.bucket = g.bucket group by 1, 2)"


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.chunk(positioned(spark, sf_dir).withColumn("bucket", bucket_id("o_custkey", 4)), 1000)


@query("bucket_histogram", f"{_GRID} select chunk, bucket, n from n")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bucketed(spark, sf_dir)
    chunks = -(-table(spark, sf_dir, "orders").count() // 1000)
    return partitioning.bucket_histogram(df, 16, chunk="chunk", chunks=chunks).select("chunk", "bucket", "n")


@query("bucket_offsets", f'{_GRID} select chunk, bucket, cast(coalesce(sum(n) over (partition by bucket order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from n')
def bucket_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bucketed(spark, sf_dir)
    chunks = -(-table(spark, sf_dir, "orders").count() // 1000)
    return partitioning.bucket_histogram(df, 16, chunk="chunk", chunks=chunks).select("chunk", "bucket", "offset")


@query("bucket_totals", f"with b as ({_BUCKETS}), k as (select unnest(range(32)) as bucket) select k.bucket, count(b.pos) as n from k left join b on b.bucket = k.bucket group by 1")
def bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many buckets as there are in the data: the empty ones count 0."""
    return partitioning.bucket_totals(bucketed(spark, sf_dir), 32)


@query("partition_stable", f"select o_orderkey, bucket, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})")
def partition_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.partition_by_bucket(bucketed(spark, sf_dir)).select("o_orderkey", "bucket", "pos_in")


@query("partition_in_ranges", f"select o_orderkey, bucket, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})")
def partition_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable partition of a table of many ranges: a bucket's rows are in several tasks."""
    return prefix.position_within(bucketed(spark, sf_dir), ["bucket"], "pos", chunk=4096).select("o_orderkey", "bucket", "pos_in")


@query("partition_strings", f"select o_orderstatus, bucket, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})")
def partition_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.partition_by_bucket(bucketed(spark, sf_dir)).select("o_orderstatus", "bucket", "pos_in")


@query("partition_validity", f"select bucket, row_number() over (partition by bucket order by pos) - 1 as pos_in, o_custkey % 3 <> 0 as valid from ({_BUCKETS})")
def partition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULLs go where their rows go."""
    return partitioning.partition_by_bucket(_masked(spark, sf_dir)).select("bucket", "pos_in", is_valid(F.col("value")).alias("valid"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with ``value``: the status, NULL where the customer's key is divisible by 3."""
    return bucketed(spark, sf_dir).withColumn("value", with_validity(F.col("o_orderstatus"), F.pmod(F.col("o_custkey"), F.lit(3))))


@query("validity_equal", f"with a as (select o_custkey % 3 <> 0 as f from orders), b as (select o_custkey % 5 <> 0 as f from orders) select true as same, not exists ((select * from a except all select * from b) union all (select * from b except all select * from a)) as other")
def validity_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the flags of a column those of its partitions; are they those of another column."""
    flags = lambda n: table(spark, sf_dir, "orders").select((F.pmod(F.col("o_custkey"), F.lit(n)) != 0).alias("f"))
    parts = partition_validity(spark, sf_dir).select(F.col("valid").alias("f"))
    return spark.createDataFrame([(same_validity(flags(3), parts), same_validity(flags(3), flags(5)))], "same boolean, other boolean")


@query("partition_lengths", f"select bucket, count(*) as n from ({_BUCKETS}) group by 1")
def partition_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.partition_lengths(bucketed(spark, sf_dir))


_TWO = f"with a as (select *, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})), b as (select *, o_orderkey % 4 as bucket2 from a), c as (select *, row_number() over (partition by bucket2 order by bucket, pos_in) - 1 as pos_in2 from b)"


@query("repartition_two_level", f"{_TWO} select o_orderkey, bucket2, pos_in2 from c")
def repartition_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = partitioning.partition_by_bucket(bucketed(spark, sf_dir))
    return partitioning.repartition_bucket(df, bucket_id("o_orderkey", 2)).select("o_orderkey", "bucket2", "pos_in2")


_MASK = f"with a as (select *, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})), c as (select o_orderkey, o_orderkey % 4 as bucket2, case when o_custkey % 3 <> 0 then o_orderstatus end as value, row_number() over (partition by o_orderkey % 4 order by bucket, pos_in) - 1 as pos_in2 from a)"


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.repartition_bucket(partitioning.partition_by_bucket(_masked(spark, sf_dir)), bucket_id("o_orderkey", 2))


@query("repartition_strings", f"{_MASK} select bucket2, pos_in2, value from c")
def repartition_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).select("bucket2", "pos_in2", "value")


@query("repartition_validity", f"{_MASK} select bucket2, pos_in2, value is not null as valid from c")
def repartition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).select("bucket2", "pos_in2", is_valid(F.col("value")).alias("valid"))


@query("histogram_of_partitions", f"with b as ({_BUCKETS}), g as (select c as chunk, k as bucket2 from (select unnest(range(16)) as c), (select unnest(range(4)) as k)), n as (select g.chunk, g.bucket2, count(b.pos) as n from g left join b on b.bucket = g.chunk and b.o_orderkey % 4 = g.bucket2 group by 1, 2) select chunk, bucket2, n, cast(coalesce(sum(n) over (partition by bucket2 order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from n")
def histogram_of_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each partition go to each new bucket, and where they begin there."""
    df = bucketed(spark, sf_dir).withColumn("bucket2", bucket_id("o_orderkey", 2))
    return partitioning.bucket_histogram(df, 4, "bucket2", chunk="bucket", chunks=16).withColumnRenamed("bucket", "bucket2")


@query("chunk_fixed", f"select o_orderkey, pos // 7 as chunk from ({_POS})")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.chunk(positioned(spark, sf_dir), 7).select("o_orderkey", "chunk")


@query("chunk_sizes", f"with p as ({_POS}), m as (select count(*) as n from p) select o_orderkey, case when pos < n // 2 then 0 when pos < n // 2 + n // 3 then 1 else 2 end as chunk from p, m")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = positioned(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    return partitioning.chunk_with_sizes(df, [n // 2, n // 3, n - n // 2 - n // 3]).select("o_orderkey", "chunk")


@query("flatten", f"select o_orderkey, row_number() over (order by bucket, pos) - 1 as flat from ({_BUCKETS})")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.flatten(partitioning.partition_by_bucket(bucketed(spark, sf_dir))).select("o_orderkey", "flat")


_INDEX = f"with a as (select *, row_number() over (partition by bucket order by pos) - 1 as pos_in from ({_BUCKETS})), ix as (select bucket, pos_in as i, (pos_in // 2) * 2 as target from a), u as (select distinct bucket, target from ix), r as (select bucket, target, row_number() over (order by bucket, target) - 1 as flat from u)"


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = partitioning.partition_by_bucket(bucketed(spark, sf_dir)).select("o_orderkey", "bucket", "pos_in")
    index = df.select("bucket", F.col("pos_in").alias("i"), (F.floor(F.col("pos_in") / 2) * 2).cast("bigint").alias("at"))
    return partitioning.flatten_indexed(df, index)


@query("flatten_indexed_data", f"{_INDEX} select a.o_orderkey, r.flat from a join r on r.bucket = a.bucket and r.target = a.pos_in")
def flatten_indexed_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[0].select("o_orderkey", "flat")


@query("flatten_indexed_index", f"{_INDEX} select row_number() over (order by ix.bucket, ix.i) - 1 as flat_i, r.flat from ix join r on r.bucket = ix.bucket and r.target = ix.target")
def flatten_indexed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[1]


@query("flatten_roundtrip", "select count(*) as n, cast(sum(o_orderkey) as bigint) as s, min(o_orderkey) as lo, max(o_orderkey) as hi from orders")
def flatten_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket by a real hash, partition, flatten: every row is there once."""
    df = positioned(spark, sf_dir)
    parts = partitioning.partition_by_bucket(partitioning.with_bucket(df, ["o_custkey", "o_orderstatus"], 10))
    return partitioning.flatten(parts).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("hash_roundtrip", "select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by 1, 2, 3")
def hash_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each hash of three columns, with the columns it stands for."""
    df = table(spark, sf_dir, "lineitem").withColumn("h", row_hash("l_returnflag", "l_linestatus", "l_linenumber"))
    return df.groupBy("h").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_linenumber").alias("l_linenumber"), F.count(F.lit(1)).alias("n")).drop("h")


_HASHED = f"with b as ({_BUCKETS}) select bucket, o_orderstatus, o_custkey % 7 as k, count(*) as n from b group by 1, 2, 3"


@query("hash_partitioned", _HASHED)
def hash_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are partitioned already are hashed, and a further one is added to the hash, by registered kernels."""
    df = partitioning.partition_by_bucket(bucketed(spark, sf_dir)).withColumn("k", F.pmod(F.col("o_custkey"), F.lit(7)))
    first = _kernel("hash=", "str")(F.col("o_orderstatus"))
    df = df.withColumn("h", _kernel("hash+=", "u64", "u64")(first, F.col("k")))
    return df.groupBy("bucket", "h").agg(F.min("o_orderstatus").alias("o_orderstatus"), F.min("k").alias("k"), F.count(F.lit(1)).alias("n")).drop("h")


@query("hash_null", "select count(*) as n, count(nullif(l_partkey, l_suppkey)) as valid from lineitem")
def hash_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined hash is valid where all its columns are."""
    return items(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count(row_hash("l_orderkey", "part_or_null")).alias("valid"))


def _string_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings hashed into 2**10 buckets, put there physically, partitioned and flattened."""
    df = partitioning.with_bucket(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], 10)
    parts = partitioning.partition_by_bucket(df, pos="c_custkey")
    placed = partitioning.place(parts, 10, partitions=spark.sparkContext.defaultParallelism)
    return partitioning.flatten(placed)


@query("string_hash_partition", "select c_custkey, c_name, 1 as buckets, true as inside from customer")
def string_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of the flat column with the number of buckets it is in, and whether it lies inside its bucket's span there."""
    flat = Workspace(spark, "flat").table(_string_partition(spark, sf_dir), "flat")
    spans = flat.groupBy("bucket").agg(F.min("flat").alias("first"), (F.max("flat") - F.min("flat") + 1 == F.count(F.lit(1))).alias("whole"))
    kinds = flat.groupBy("c_name").agg(F.count_distinct("bucket").cast("int").alias("buckets"))
    rows = flat.join(spans, "bucket").join(kinds, "c_name")
    return rows.select("c_custkey", "c_name", "buckets", (F.col("whole") & (F.col("flat") == F.col("first") + F.col("pos_in"))).alias("inside"))


@query("string_hash_flat", "select count(*) as n, count(*) as places, 0 as first, count(*) - 1 as last from customer")
def string_hash_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat positions are those of a table without gaps."""
    flat = _string_partition(spark, sf_dir)
    return flat.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("flat").alias("places"), F.min("flat").cast("int").alias("first"), F.max("flat").alias("last"))


@query("prefix_sum", "select o_orderkey, cast(sum(o_custkey) over (order by o_orderkey) + 1 as bigint) as prefix from orders")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.prefix_sum(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 1).select("o_orderkey", "prefix")


@query("prefix_sum_parallel", "select o_orderkey, cast(sum(o_custkey) over (order by o_orderkey) + 1 as bigint) as prefix from orders")
def prefix_sum_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.prefix_sum_parallel(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 1, chunk=4096).select("o_orderkey", "prefix")


_SOME = "select o_orderkey, case when o_custkey % 3 = 0 and o_orderkey > 400 then o_custkey end as v from orders"


@query("prefix_sum_null", f"select o_orderkey, cast(sum(v) over (order by o_orderkey) + 1 as bigint) as prefix from ({_SOME})")
def prefix_sum_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL up to the first value, then each NULL has the sum so far."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") > 400), F.col("o_custkey")).alias("v"))
    return prefix.prefix_sum_parallel(df, "v", "o_orderkey", 1, chunk=128).select("o_orderkey", "prefix")
