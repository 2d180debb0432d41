"""Approval rules as data: conditions, rule truth, first match, instances and decisions (RUL1 to RUL12).

A workflow is one row with its rules as an array ordered by priority.  A receipt
meets its workflow in one equi join and is judged by higher-order functions on
that array, so no row is multiplied by rules or conditions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.core import AsOf, lookup, ts

ACTIONS = ["approve", "reject", "require_approval", "escalate"]

CONDITION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
    ]
)
RULE = T.StructType(
    [
        T.StructField("order", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("logic", T.StringType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
        T.StructField("action", T.StringType()),
        T.StructField("escalation_role", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str | float | list[str]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    action: str
    priority: int
    conditions: list[Condition] = field(default_factory=list)
    logic: str = "AND"
    escalation_role: str | None = None


def amount_rule(rule_id: str, name: str, operator: str, limit: float, action: str, priority: int) -> Rule:
    return Rule(rule_id, name, action, priority, [Condition("amount", operator, limit)])


# The two rule templates.
BASIC = [
    amount_rule("basic_small", "Auto-aprobación montos pequeños", "less_equal", 50000, "approve", 100),
    amount_rule("basic_medium", "Aprobación requerida montos medianos", "less_equal", 500000, "require_approval", 90),
    amount_rule("basic_large", "Escalación montos altos", "greater_than", 500000, "escalate", 80),
]
ENTERPRISE = [
    Rule(
        "office",
        "Auto-aprobación gastos oficina",
        "approve",
        100,
        [Condition("category", "in", ["Oficina", "Materiales", "Suministros"]), Condition("amount", "less_equal", 100000)],
    ),
    Rule(
        "travel",
        "Aprobación viajes",
        "require_approval",
        95,
        [Condition("category", "in", ["Viajes", "Transporte", "Alojamiento"])],
    ),
    Rule(
        "representation",
        "Escalación gastos representación",
        "escalate",
        90,
        [Condition("category", "in", ["Entretenimiento", "Comidas de negocios"]), Condition("amount", "greater_than", 200000)],
    ),
]


WORKFLOW = T.StructType(
    [
        T.StructField("workflow_id", T.LongType()),
        T.StructField("rules", T.ArrayType(RULE)),
        T.StructField("default_action", T.StringType()),
    ]
)


def workflow_table(spark: SparkSession, workflows: dict[int, tuple[list[Rule], str]]) -> DataFrame:
    """RUL7: rule lists with their default actions as a table, rules ordered by priority, then by position.

    The rules written in code become a constant in the plan; rules kept in a
    table need only the same three columns.
    """

    def plain(condition: Condition) -> dict:
        listed = isinstance(condition.value, (list, tuple))
        return {
            "field": condition.field,
            "operator": condition.operator,
            "value": None if listed else str(condition.value),
            "values": list(condition.value) if listed else None,
        }

    def ordered(rules: list[Rule]) -> list[dict]:
        rows = [
            {
                "order": -rule.priority,
                "position": position,
                "rule_id": rule.rule_id,
                "name": rule.name,
                "logic": rule.logic,
                "conditions": [plain(c) for c in rule.conditions],
                "action": rule.action,
                "escalation_role": rule.escalation_role,
            }
            for position, rule in enumerate(rules)
        ]
        return sorted(rows, key=lambda row: (row["order"], row["position"]))

    rows = [
        {"workflow_id": number, "rules": ordered(rules), "default_action": action}
        for number, (rules, action) in workflows.items()
    ]
    text = json.dumps(rows, ensure_ascii=False)
    return spark.sql("SELECT 1 AS one").select(F.inline(F.from_json(F.lit(text), T.ArrayType(WORKFLOW))))


def facts(receipts: DataFrame, users: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """RUL4: the facts of a receipt that conditions can name, as text.

    ``roles`` gives the active roles of a user as an array column ``roles``.
    """
    people = users.select("user_id", "role", "email")
    rows = receipts.join(people, "user_id", "left")
    if roles is not None:
        rows = rows.join(roles.select("user_id", "roles"), "user_id", "left")
    held = F.array_join("roles", ",") if roles is not None else F.lit("")
    located = F.col("lat").isNotNull() if "lat" in receipts.columns else F.lit(False)
    pairs = {
        "amount": F.col("total_amount"),
        "category": F.coalesce("category", F.lit("Sin categoría")),
        "merchant": F.col("company_name"),
        "description": F.coalesce("description", F.lit("")),
        "user_id": F.col("user_id"),
        "user_role": F.col("role"),
        "user_roles": F.coalesce(held, F.lit("")),
        "user_email": F.col("email"),
        "day_of_week": F.coalesce(F.weekday("date"), F.lit(0)),
        "month": F.coalesce(F.month("date"), F.lit(1)),
        "is_weekend": F.coalesce(F.weekday("date") >= 5, F.lit(False)),
        "has_location": located,
    }
    flat = [part for name, value in pairs.items() for part in (F.lit(name), value.cast("string"))]
    return rows.withColumn("facts", F.create_map(*flat))


def holds(known: Column, condition: Column) -> Column:
    """RUL1: whether one condition holds; numbers compare as numbers, an unfit type is false.

    A missing fact equals nothing and is in no list, so the negated operators
    are true for it.
    """
    fact = F.try_element_at(known, condition["field"])
    value, listed, op = condition["value"], condition["values"], condition["operator"]
    a, b = fact.try_cast("double"), value.try_cast("double")

    def sure(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    equal = sure(F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(fact == value))
    within = sure(F.when(listed.isNotNull(), F.array_contains(listed, fact)).otherwise(value.contains(fact)))
    has = sure(F.lower(fact).contains(F.lower(value)))
    return (
        F.when(op == "equals", equal)
        .when(op == "not_equals", ~equal)
        .when(op == "greater_than", sure(a > b))
        .when(op == "less_than", sure(a < b))
        .when(op == "greater_equal", sure(a >= b))
        .when(op == "less_equal", sure(a <= b))
        .when(op == "contains", has)
        .when(op == "not_contains", ~has)
        .when(op == "in", within)
        .when(op == "not_in", ~within)
        .otherwise(F.lit(False))
    )


def rule_true(known: Column, rule: Column) -> Column:
    """RUL2: all conditions, or any for OR; a rule without conditions is true."""
    conditions = rule["conditions"]
    test = lambda c: holds(known, c)
    return (
        F.when(F.coalesce(F.size(conditions), F.lit(0)) <= 0, True)
        .when(F.upper(rule["logic"]) == "OR", F.exists(conditions, test))
        .otherwise(F.forall(conditions, test))
    )


def condition_results(known: DataFrame, workflows: DataFrame) -> DataFrame:
    """RUL1 as a report: every condition of every rule for every receipt."""
    rows = known.join(workflows, "workflow_id").select("receipt_id", "facts", F.explode("rules").alias("rule"))
    each = rows.select("receipt_id", "facts", "rule", F.posexplode("rule.conditions").alias("condition_no", "condition"))
    return each.select(
        "receipt_id",
        F.col("rule.rule_id").alias("rule_id"),
        F.col("condition_no").cast("int").alias("condition_no"),
        holds(F.col("facts"), F.col("condition")).alias("holds"),
    )


def rule_results(known: DataFrame, workflows: DataFrame) -> DataFrame:
    """RUL2 as a report: every rule for every receipt."""
    rows = known.join(workflows, "workflow_id").select("receipt_id", "facts", F.explode("rules").alias("rule"))
    return rows.select("receipt_id", F.col("rule.rule_id").alias("rule_id"), rule_true(F.col("facts"), F.col("rule")).alias("applies"))


def rule_confidence(rule: Column) -> Column:
    """RUL5: .5 without conditions, .6 for one, .8 for more, .1 for every strict amount bound, at most 1."""
    conditions = rule["conditions"]
    n = F.coalesce(F.size(conditions), F.lit(0))
    strict = F.filter(
        conditions, lambda c: (c["field"] == "amount") & c["operator"].isin("greater_than", "less_than")
    )
    base = F.when(n > 1, 0.8).otherwise(0.6) + F.size(strict) * 0.1
    return F.when(n <= 0, 0.5).otherwise(F.least(F.lit(1.0), base))


def next_approver(rule: Column) -> Column:
    """RUL6: the escalation role, for actions that need someone to act."""
    return F.when(rule["action"].isin("escalate", "require_approval"), rule["escalation_role"])


def evaluate(known: DataFrame, workflows: DataFrame) -> DataFrame:
    """RUL3: the first matching rule by priority, else the workflow's default action at confidence .5."""
    rows = known.join(workflows, "workflow_id")
    matching = F.filter("rules", lambda rule: rule_true(F.col("facts"), rule))
    picked = rows.withColumn("_rule", F.get(matching, F.lit(0)))
    rule = F.col("_rule")
    action = F.coalesce(rule["action"], F.col("default_action"))
    return picked.select(
        "receipt_id",
        "user_id",
        "workflow_id",
        "created_at",
        rule["rule_id"].alias("applied_rule_id"),
        action.alias("action"),
        F.when(rule.isNotNull(), rule_confidence(rule)).otherwise(0.5).alias("confidence"),
        F.when(rule.isNotNull(), next_approver(rule)).alias("next_approver_role"),
        (action == "approve").alias("auto_approved"),
    )


def instances(evaluations: DataFrame, due_days: int = 3) -> DataFrame:
    """RUL8: approval instances: approved at once, or pending with a due date."""
    auto = F.col("auto_approved")
    entry = F.struct(F.lit("auto_approved").alias("action"), F.col("created_at").alias("timestamp"))
    return evaluations.select(
        F.col("receipt_id").alias("instance_id"),
        "receipt_id",
        "workflow_id",
        "applied_rule_id",
        F.col("next_approver_role").alias("current_approver_role"),
        F.when(auto, "auto_approved").otherwise("pending").alias("status"),
        F.when(~auto, F.col("created_at") + F.make_interval(days=F.lit(due_days))).alias("due_date"),
        F.when(auto, F.array(entry)).otherwise(F.array().cast("array<struct<action:string,timestamp:timestamp>>")).alias("approval_chain"),
        F.lit(0).alias("escalation_count"),
        "created_at",
    )


def apply_decisions(pending: DataFrame, decisions: DataFrame, due_days: int = 3) -> DataFrame:
    """RUL9: the first decision on each pending instance; anything later finds it no longer pending.

    An escalated instance is not pending either, so one decision per instance
    is all that can apply.
    """
    first = decisions.groupBy("instance_id").agg(
        F.min_by(F.struct("decided_at", "decision", "approver_id"), F.struct("decided_at", "decision_id")).alias("_d")
    )
    rows = pending.join(first, "instance_id", "left")
    decision = F.when(F.col("status") == "pending", F.col("_d.decision"))
    states = {"approve": "approved", "reject": "rejected", "escalate": "escalated"}
    applied = lookup(decision, states).isNotNull()
    escalated = applied & (decision == "escalate")
    entry = F.struct(F.col("_d.decision").alias("action"), F.col("_d.decided_at").alias("timestamp"))
    later = F.col("_d.decided_at") + F.make_interval(days=F.lit(due_days))
    return rows.select(
        "instance_id",
        "receipt_id",
        F.coalesce(lookup(decision, states), F.col("status")).alias("status"),
        F.when(applied, F.col("_d.approver_id")).alias("decided_by"),
        (F.col("escalation_count") + F.when(escalated, 1).otherwise(0)).alias("escalation_count"),
        F.when(escalated, later).otherwise(F.col("due_date")).alias("due_date"),
        F.when(applied, F.array_append("approval_chain", entry)).otherwise(F.col("approval_chain")).alias("approval_chain"),
    )


def active_roles(assignments: DataFrame) -> DataFrame:
    """RUL10: every new assignment deactivates the earlier ones of the user in the company."""
    latest = assignments.groupBy("user_id", "company_id").agg(
        F.max_by("role_id", F.struct("assigned_at", "assignment_id")).alias("role_id")
    )
    return latest.select("user_id", "company_id", F.array("role_id").alias("roles"))


def overdue(approvals: DataFrame, as_of: AsOf) -> DataFrame:
    """RUL11: pending approvals past their due date, with whole days overdue."""
    late = approvals.filter(F.col("status").isin("pending", "en_revision") & (F.col("due_date") < ts(as_of)))
    seconds = F.unix_timestamp(ts(as_of)) - F.unix_timestamp("due_date")
    return late.withColumn("days_overdue", F.floor(seconds / 86400))


def priority_band(amount: Column) -> Column:
    """RUL12: notification priority by amount."""
    return F.when(amount > 1_000_000, "urgent").when(amount > 500_000, "high").when(amount > 100_000, "medium").otherwise("low")
