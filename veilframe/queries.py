"""One query for each operator family over the test tables, each with the same result as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expected
from .fixtures import people_sql
from .functions import typed
from .functions.dialect import DUCK, SPARK
from .functions.digest import MaskPlan
from .operators import changes, detection, masking, paging, validation
from .plans.registry import TPCH
from .streaming import apply

#: For queries and tests only; a user passes the content of a key file.
DEMO_KEY = b"veilframe demonstration key, for tests only."
#: column, strategy, kind
MASKS = (
    ("email", "fake_email", "text"), ("mobile", "cn_mobile", "text"), ("postal", "cn_postal_code", "text"), ("birth_text", "cn_date", "text"),
    ("id_card", "cn_id_card", "text"), ("bank_card", "cn_bank_card", "text"), ("uscc", "cn_uscc", "text"), ("address", "cn_address", "text"),
    ("city", "cn_city", "text"), ("person_name", "cn_person_name", "text"), ("nickname", "format_random", "text"), ("email", "redact", "text"),
    ("nickname", "blank", "text"), ("nickname", "null", "text"),
)
DETECTED = ["email", "mobile", "postal", "birth_text", "id_card", "bank_card", "uscc", "ip", "uuid", "city", "person_name", "nickname", "link", "order_no", "note"]


def _people(d, table: str = "customer", key: str = "c_custkey") -> str:
    """People with two negative columns: digits under an order's name, and free text."""
    return f"SELECT *, mobile AS order_no, CASE WHEN id % 10 = 0 THEN email ELSE nickname END AS note FROM ({people_sql(d, table, key)}) p2"


def people(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    from .functions.run import INPUT, over

    return over(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key), _people(SPARK, INPUT, key))


def plan_for(column: str, strategy: str, kind: str = "text") -> MaskPlan:
    return MaskPlan(strategy, f"parquet/people/{column}", "k1", DEMO_KEY, kind)


# ------------------------------------------------------------------ masks


def mask_query(column: str, strategy: str, kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_column(people(spark, sf_dir), column, plan_for(column, strategy, kind), ["id", column])


def mask_oracle(column: str, strategy: str, kind: str) -> str:
    return masking.masked_select(DUCK, f"({_people(DUCK)}) src_", ["id", column], column, plan_for(column, strategy, kind))


def mask_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = people(spark, sf_dir).select("id", F.encode(F.repeat("email", 3), "UTF-8").alias("payload"))
    return masking.mask_column(d, "payload", plan_for("payload", "format_random", "bytes"), ["id"]).select("id", F.hex("payload_masked").alias("payload_hex"), "payload_error")


def mask_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline: 150,000 addresses at sf0.1 masked and validated, with nothing written."""
    p = people(spark, sf_dir, "orders", "o_orderkey").select("id", "email")
    m = masking.mask_column(p, "email", plan_for("email", "fake_email"), ["id"])
    j = p.join(m, "id", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("email") == F.col("email_masked"), 1).otherwise(0)).alias("unchanged"), F.sum(F.when(F.col("email_masked").isNull(), 1).otherwise(0)).alias("unmasked"), F.count_distinct("email_masked").alias("distinct_masked"), F.min("email_masked").alias("least"))


def _orders_oracle() -> str:
    src = f"SELECT id, email FROM ({people_sql(DUCK, 'orders', 'o_orderkey')}) q_"
    m = masking.masked_select(DUCK, f"({src}) s_", ["id", "email"], "email", plan_for("email", "fake_email"))
    return f"SELECT count(*) AS n_rows, CAST(sum(CASE WHEN email = email_masked THEN 1 ELSE 0 END) AS bigint) AS unchanged, CAST(sum(CASE WHEN email_masked IS NULL THEN 1 ELSE 0 END) AS bigint) AS unmasked, count(DISTINCT email_masked) AS distinct_masked, min(email_masked) AS least FROM ({m}) m_"


# ------------------------------------------------------------------ detection


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.evidence(people(spark, sf_dir), DETECTED).where("rule <> 'cn_address'")


def detect_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.evidence(people(spark, sf_dir), ["address", "city"])


def detect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.verdicts(people(spark, sf_dir), ["email", "mobile", "uuid", "note", "city"], reviewed={"note": "sensitive"}, skip=("city",))


# ------------------------------------------------------------------ rows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.count(_read(spark, sf_dir, "orders"))


def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, more = paging.sample(_read(spark, sf_dir, "orders"), "o_orderpriority", 3)
    return values.select("value", F.lit(more).alias("truncated"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "conversations")
    return paging.page(d, ["conv_id", "turn"], ["role"], [3, 0], 20)


def bounded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_within(_read(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"], [10], 16, 4096)


def row_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.byte_budget(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


def batch_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.batched(_read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 64)


def _tampered(p: DataFrame) -> DataFrame:
    """A masked copy with one key missing, one too many, and some values that weren't masked."""
    m = masking.mask_column(p, "email", plan_for("email", "fake_email"), ["id", "email", "nickname"])
    t = m.select("id", F.when(F.col("id") % 100 == 7, F.col("email")).otherwise(F.col("email_masked")).alias("email"), F.when(F.col("id") % 50 == 9, None).otherwise(F.lit("x")).alias("nickname"))
    return t.where("id <> 5").unionByName(t.where("id = 6").withColumn("id", F.lit(-1).cast("long")))


def lockstep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "email", "nickname")
    t = p.where("id <> 5").withColumn("email", F.when(F.col("id") % 10 == 1, F.lit("other")).otherwise(F.col("email")))
    return changes.lockstep(p, t, ["id"], ["email", "nickname"])


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "nickname")
    m = masking.mask_column(p, "nickname", plan_for("nickname", "fake_email"), ["id", "nickname"])
    return changes.row_changes(m, ["id"], ["nickname"])


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "nickname", "city")
    m = masking.mask_column(p, "nickname", plan_for("nickname", "fake_email"), ["id", "nickname"])
    moved = p.withColumn("nickname", F.when(F.col("id") % 30 == 1, F.lit("moved")).otherwise(F.col("nickname")))
    return changes.merged(moved, changes.row_changes(m, ["id"], ["nickname"]), ["id"], ["nickname"])


def validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "email", "nickname")
    return validation.sum_issues(validation.compare_rows(p, _tampered(p), ["id"], ["email", "nickname"]))


def independent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "email", "nickname")
    return validation.independent_check(p, _tampered(p), "id", ["email", "nickname"])


def key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.key_order_issues(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is missing, after every seventh customer was taken away."""
    k = TPCH.table("orders").foreign_keys[0]
    parent = _read(spark, sf_dir, k.parent).where("c_custkey % 7 <> 0")
    return validation.orphans(_read(spark, sf_dir, "orders").select("o_orderkey", *k.columns), parent, list(k.columns), list(k.parent_columns))


def multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    return validation.multiset_difference(a, a.where("c_nationkey <> 3")).groupBy("c_nationkey", "c_mktsegment", "side").count().withColumnRenamed("count", "n")


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "customer")
    return d.select("c_custkey", validation.row_digest(d, "customer", ["c_custkey", "c_name"], {"c_custkey": "int"}).alias("h"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.content_digest(_read(spark, sf_dir, "customer"), "customer", ["c_custkey"], ["c_custkey", "c_name"], {"c_custkey": "int"})


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("id", "nickname")
    m = masking.mask_column(p, "nickname", plan_for("nickname", "fake_email"), ["id", "nickname"]).where("nickname IS NOT NULL")
    return masking.mapping_table(m.select(F.sha2("nickname", 256).alias("fingerprint"), F.col("nickname_masked").alias("masked"), F.col("id").alias("turn")))


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold more than mail addresses, so the mask refuses them."""
    d = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@example.org"))).alias("email"))
    return masking.violations(masking.mask_column(d, "email", plan_for("email", "fake_email"), ["c_custkey"]), ["email"])


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of each kind, and of text that is read as a kind first."""
    d = _read(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("o_orderkey % 1000 / 8D").alias("f"), F.expr("CAST(o_orderkey % 997 / 4 AS decimal(20, 4))").alias("p"), F.expr("o_orderkey % 2 = 0").alias("b"),
        F.expr("date_add(date'1960-01-01', CAST(o_orderkey % 30000 AS int))").alias("d"), F.expr("timestamp_ntz'1969-12-31 23:00:00' + make_dt_interval(0, 0, 0, CAST(o_orderkey % 7200 + o_orderkey % 4 / 4 AS decimal(18, 6)))").alias("t"),
    )
    kinds = {f.name: f.dataType for f in d.schema}
    read = typed.parsed(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 01:02:03.50")), "datetime")
    return d.select("o_orderkey", *[typed.canonical(F.col(c), kinds[c]).alias(c) for c in ("f", "p", "b", "d", "t")], typed.canonical(read, T.TimestampNTZType()).alias("r"))


def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.limited(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 100)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five columns of three tables, one seen only in part."""
    parts = [_read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("rows")).selectExpr(f"'{t}' AS table_name", f"'{c}' AS column_name", "rows", f"{w} AS whole") for t, c, w in (("customer", "c_name", "true"), ("customer", "c_mktsegment", "true"), ("orders", "o_orderpriority", "false"), ("conversations", "role", "true"), ("conversations", "text", "true"))]
    return paging.coverage(reduce(DataFrame.unionByName, parts))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of three runs, of which one was never begun."""
    r = _read(spark, sf_dir, "orders").selectExpr("concat('run', o_orderkey % 3) AS run_id", "o_orderkey")
    known, unknown = apply.of_known_runs(r, spark.createDataFrame([("run0",), ("run1",), ("run0",), ("run9",)], "run_id string"))
    count = lambda d, k: d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.lit(k))
    return count(known, True).unionByName(count(unknown, False))


# ------------------------------------------------------------------ batches and progress


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paging.batched(people(spark, sf_dir).select("id", "nickname"), ["id"], 64)
    return apply.planned_receipts(b, "run0", F.col("nickname").isNotNull())


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir)


def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.receipt_summary(_receipts(spark, sf_dir))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.progress_events(_receipts(spark, sf_dir))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _receipts(spark, sf_dir)
    return apply.reconcile(apply.progress_events(r), r.where("batch_sequence <> 1").withColumn("affected_rows", F.when(F.col("batch_sequence") == 2, 1).otherwise(F.col("affected_rows"))))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target whose first 100 rows are masked, with one row tampered on either side of the checkpoint."""
    p = people(spark, sf_dir).select("id", "email")
    m = masking.mask_column(p, "email", plan_for("email", "fake_email"), ["id", "email"])
    order = paging.batched(m, ["id"], 1)
    t = order.select("id", F.when(F.col("id").isin(3, 140), F.lit("tampered")).when(F.col("batch_sequence") < 100, F.col("email_masked")).otherwise(F.col("email")).alias("email"))
    return apply.resume_issues(p, m, t, ["id"], ["email"], 100)


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of single-value rules on columns of known kind."""
    p = people(spark, sf_dir)
    parts = []
    for column, rule in (("email", "email"), ("mobile", "cn_mobile"), ("id_card", "cn_id_card"), ("nickname", "uuid"), ("city", "cn_city")):
        hit = detection.whole_value_matches(p.select(F.coalesce(column, F.lit("-")).alias("v")), "v")
        parts += [hit.select(F.lit(r).alias("rule"), F.lit(r == rule).alias("expected"), F.col(r).alias("found")) for r in ("email", "cn_mobile", "cn_id_card", "uuid", "cn_city")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return detection.evaluation(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"mask_{s}" if s != "format_random" else "mask_format_random_text": partial(mask_query, c, s, k) for c, s, k in MASKS},
    "mask_format_random_bytes": mask_bytes, "mask_validate_orders": mask_orders, "mask_refusals": refusals, "mask_mapping": mapping,
    "detect_evidence": detect, "detect_addresses": detect_addresses, "detect_verdicts": detect_verdicts, "detect_evaluation": evaluate,
    "count_rows": count_rows, "sample_values": sample_values, "keyset_page": keyset_page, "bounded_page": bounded_page, "row_costs": row_costs, "typed_values": typed_values, "limited_rows": limited_rows, "coverage": coverage, "run_records": run_records, "batch_ordinals": batch_ordinals,
    "lockstep_counts": lockstep_counts, "row_changes": row_changes, "merged_rows": merged_rows,
    "validate_issues": validate_issues, "independent_check": independent_check, "key_issues": key_issues, "orphan_rows": orphan_rows, "multiset_difference": multiset, "row_digests": row_digests, "content_digest": content_digest,
    "receipts": receipts, "receipt_summary": receipt_summary, "progress_events": progress, "reconcile_receipts": reconcile, "resume_issues": resume,
}

# ------------------------------------------------------------------ the same as SQL

_P = f"({_people(DUCK)}) people_"
_MASKED = masking.masked_select(DUCK, _P, ["id", "email", "nickname"], "email", plan_for("email", "fake_email"))
_NICK = masking.masked_select(DUCK, _P, ["id", "nickname", "city"], "nickname", plan_for("nickname", "fake_email"))
_TAMPERED = f"""t0 AS (SELECT id, CASE WHEN id % 100 = 7 THEN email ELSE email_masked END AS email, CASE WHEN id % 50 = 9 THEN NULL ELSE 'x' END AS nickname FROM ({_MASKED}) m_),
t AS (SELECT * FROM t0 WHERE id <> 5 UNION ALL SELECT -1, email, nickname FROM t0 WHERE id = 6), p AS (SELECT id, email, nickname FROM {_P})"""
_BE = "from_hex(lpad(to_hex({}), 8, '0'))"


def _field(x: str) -> str:
    return f"{_BE.format(f'strlen({x})')} || encode({x})"


_ROW_DIGEST = f"sha256({_field(chr(39) + 'customer' + chr(39))} || {_field(chr(39) + 'c_custkey' + chr(39))} || {_field(chr(39) + 'int' + chr(39))} || from_hex('01') || {_field('CAST(c_custkey AS varchar)')} || {_field(chr(39) + 'c_name' + chr(39))} || {_field(chr(39) + 'text' + chr(39))} || from_hex('01') || {_field('c_name')})"
_BATCHED = f"SELECT (row_number() OVER (ORDER BY id) - 1) // 64 AS b, nickname FROM {_P}"
_RECEIPTS = f"SELECT 'run0' AS run_id, CAST(row_number() OVER (ORDER BY b) - 1 AS bigint) AS batch_sequence, 'run0-' || CAST(row_number() OVER (ORDER BY b) - 1 AS varchar) AS batch_id, affected_rows FROM (SELECT b, CAST(count(nickname) AS bigint) AS affected_rows FROM ({_BATCHED}) b_ GROUP BY b HAVING count(nickname) > 0) r_"
_PROGRESS = f"SELECT run_id, batch_sequence + 1 AS checkpoint_sequence, CAST(sum(affected_rows) OVER (ORDER BY batch_sequence) AS bigint) AS rows_committed, count(*) OVER (ORDER BY batch_sequence) AS committed_batches, batch_id, affected_rows FROM ({_RECEIPTS}) q_"
_DIFF = "SELECT c_nationkey, c_mktsegment FROM customer"

ORACLES: dict[str, str] = {
    **{f"mask_{s}" if s != "format_random" else "mask_format_random_text": mask_oracle(c, s, k) for c, s, k in MASKS},
    "mask_format_random_bytes": f"SELECT id, hex(payload_masked) AS payload_hex, payload_error FROM ({masking.masked_select(DUCK, f'(SELECT id, encode(repeat(email, 3)) AS payload FROM {_P}) s_', ['id'], 'payload', plan_for('payload', 'format_random', 'bytes'))}) m_",
    "mask_validate_orders": _orders_oracle(),
    "mask_refusals": "SELECT 'email' AS \"column\", 'invalid' AS code, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0",
    "mask_mapping": f"SELECT sha256(nickname) AS fingerprint, min_by(nickname_masked, id) AS masked FROM ({_NICK}) m_ WHERE nickname IS NOT NULL GROUP BY 1",
    "detect_evidence": detection.evidence_sql(DUCK, _P, DETECTED),
    "detect_addresses": expected.evidence_of(_P, ("address", "city")),
    "detect_verdicts": expected.verdicts_of(_P),
    "detect_evaluation": expected.evaluation_of(_P),
    "count_rows": "SELECT count(*) AS n FROM orders",
    "sample_values": "SELECT value, (SELECT count(DISTINCT o_orderpriority) > 3 FROM orders) AS truncated FROM (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY 1 LIMIT 3) s_",
    "keyset_page": "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) > 20 AS ahead FROM conversations WHERE (conv_id, turn) > (3, 0) ORDER BY conv_id, turn LIMIT 21",
    "bounded_page": "SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (ORDER BY c_custkey) > 16 AS ahead FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 17",
    "row_costs": "SELECT count(*) AS rows, CAST(sum(b) AS bigint) AS total_bytes, CAST(max(b) AS bigint) AS max_row_bytes FROM (SELECT strlen(CAST(c_custkey AS varchar)) + strlen(c_name) + strlen(CAST(c_nationkey AS varchar)) + strlen(c_mktsegment) AS b FROM customer) b_",
    "typed_values": """SELECT o_orderkey, printf('%g', o_orderkey % 1000 / 8.0) AS f, printf('%.4f', o_orderkey % 997 / 4.0) AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS b,
  strftime(date '1960-01-01' + CAST(o_orderkey % 30000 AS int), '%Y-%m-%d') AS d,
  strftime(timestamp '1969-12-31 23:00:00' + to_seconds(o_orderkey % 7200), '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS t,
  strftime(date '1960-01-01' + CAST(o_orderkey % 30000 AS int), '%Y-%m-%d') || 'T01:02:03.5' AS r FROM orders""",
    "limited_rows": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100",
    "coverage": "SELECT CAST(3 AS bigint) AS tables, CAST(5 AS bigint) AS columns, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM conversations) AS bigint) AS rows, false AS complete",
    "run_records": "SELECT 'run' || CAST(o_orderkey % 3 AS varchar) AS run_id, count(*) AS n, o_orderkey % 3 <> 2 AS known FROM orders GROUP BY ALL",
    "batch_ordinals": "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS bigint) AS batch_sequence, CAST((row_number() OVER (ORDER BY c_custkey) - 1) % 64 AS int) AS row_in_batch FROM customer",
    "lockstep_counts": f"SELECT count(*) AS rows, count(*) FILTER (id = 5) AS only_source, CAST(0 AS bigint) AS only_target, count(*) FILTER (id <> 5 AND id % 10 = 1) AS conflicts, CAST(0 AS bigint) AS bad_keys FROM {_P}",
    "row_changes": f"SELECT id, nickname AS expected_nickname, nickname_masked AS replacement_nickname FROM ({_NICK}) m_ WHERE nickname IS NOT NULL",
    "merged_rows": f"SELECT id, CASE WHEN id % 30 = 1 THEN 'moved' WHEN nickname IS NOT NULL THEN nickname_masked END AS nickname, city, nickname IS NOT NULL AND id % 30 <> 1 AS applied_ FROM ({_NICK}) m_",
    "validate_issues": f"""WITH {_TAMPERED}, j AS (SELECT p.id AS a, t.id AS b, p.email AS pe, t.email AS te, p.nickname AS pn, t.nickname AS tn FROM p FULL OUTER JOIN t ON p.id = t.id)
SELECT * FROM (SELECT 'fail' AS status, 'key_mismatch' AS code, '' AS "column", count(*) FILTER (a IS NULL OR b IS NULL) AS n FROM j
UNION ALL SELECT 'fail', 'unchanged_value', 'email', count(*) FILTER (pe = te) FROM j UNION ALL SELECT 'fail', 'unchanged_value', 'nickname', count(*) FILTER (pn = tn) FROM j
UNION ALL SELECT 'fail', 'conflicting_evidence', 'email', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (pe IS NULL) <> (te IS NULL)) FROM j
UNION ALL SELECT 'fail', 'conflicting_evidence', 'nickname', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (pn IS NULL) <> (tn IS NULL)) FROM j) i WHERE n > 0""",
    "independent_check": f"WITH {_TAMPERED} SELECT count(*) AS rows, count(*) FILTER (p.email = t.email) AS email_equal, count(*) FILTER (t.email IS NULL) AS email_nulls, count(DISTINCT p.email) AS email_source_distinct, count(DISTINCT t.email) AS email_target_distinct, count(*) FILTER (p.nickname = t.nickname) AS nickname_equal, count(*) FILTER (t.nickname IS NULL) AS nickname_nulls, count(DISTINCT p.nickname) AS nickname_source_distinct, count(DISTINCT t.nickname) AS nickname_target_distinct FROM p JOIN t ON p.id = t.id",
    "key_issues": "SELECT 'error' AS status, 'repeated_key' AS code, '' AS \"column\", CAST(sum(c - 1) AS bigint) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) g_ HAVING sum(c - 1) > 0",
    "orphan_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)",
    "multiset_difference": "SELECT c_nationkey, c_mktsegment, 'left' AS side, count(*) AS n FROM customer WHERE c_nationkey = 3 GROUP BY ALL",
    "row_digests": f"SELECT c_custkey, {_ROW_DIGEST} AS h FROM customer",
    "content_digest": f"WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, {_ROW_DIGEST} AS h FROM customer), b AS (SELECT i // 4096 AS k, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS n FROM r GROUP BY 1), c AS (SELECT k // 4096 AS l, sha256(string_agg(h, '' ORDER BY k)) AS h, sum(n) AS n FROM b GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY l)) AS digest, CAST(sum(n) AS bigint) AS n_rows FROM c",
    "receipts": _RECEIPTS,
    "receipt_summary": f"SELECT count(*) AS batches, CAST(coalesce(sum(affected_rows), 0) AS bigint) AS rows, max(batch_sequence) AS last_batch FROM ({_RECEIPTS}) q_",
    "progress_events": _PROGRESS,
    "reconcile_receipts": f"SELECT run_id, batch_sequence, affected_rows AS progress_rows, CASE WHEN batch_sequence = 2 THEN CAST(1 AS bigint) ELSE CAST(0 AS bigint) END AS receipt_rows FROM ({_RECEIPTS}) q_ WHERE batch_sequence = 1 OR batch_sequence = 2 AND affected_rows <> 1",
    "resume_issues": f"WITH o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM {_P}) SELECT CASE WHEN n < 100 THEN 'not_masked' ELSE 'changed' END AS kind, count(*) AS n FROM o WHERE id IN (3, 140) GROUP BY 1",
}
