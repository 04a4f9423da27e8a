"""Detection rules and masks as SQL functions of a session, made of SQL expressions, so they run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .dialect import SPARK
from .digest import MaskError, MaskPlan
from .formats import RULES


def _name(name: str) -> str:
    if not re.fullmatch("[a-z][a-z0-9_]{0,62}", name):
        raise MaskError("invalid: function name")
    return name


def register_rules(spark: SparkSession, prefix: str = "is_") -> list[str]:
    """is_email(text), is_uuid(text), …: whether a whole value has a rule's format. NULL gives NULL."""
    names = []
    for rule, body in sorted(RULES.items()):
        names.append(_name(f"{prefix}{rule}"))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {names[-1]}(v STRING) RETURNS BOOLEAN RETURN CASE WHEN v IS NOT NULL THEN {body(SPARK, 'v')} END")
    return names


def register_mask(spark: SparkSession, name: str, plan: MaskPlan) -> str:
    """name(text): the masked value; what the mask refuses stops the query with its category. The key is part of the
    function, so it lasts as long as the session and is seen by whoever can describe its functions."""
    from ..operators.masking import masked_select

    if plan.kind != "text":
        raise MaskError("unsupported: kind")
    one = masked_select(SPARK, "(SELECT v AS c)", ["1 AS one"], "c", plan)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(name)}(v STRING) RETURNS STRING RETURN (SELECT CASE WHEN c_error IS NOT NULL THEN raise_error(concat('refused: ', c_error)) ELSE c_masked END FROM ({one}))")
    return name
