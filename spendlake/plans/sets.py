"""Query SET4; SET1 to SET3 are registered with the detectors they join."""

from spendlake.operators import sets as ops
from spendlake.plans.bindings import r
from spendlake.plans.registry import query


@query("set4_similar_part_names", "", f"""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS name FROM part),
 s AS (SELECT name, list_distinct(string_split(name, ' ')) AS t FROM n),
 p AS (SELECT a.name AS name_a, b.name AS name_b, len(list_intersect(a.t, b.t)) AS i,
 len(list_distinct(list_concat(a.t, b.t))) AS u FROM s a JOIN s b ON a.name < b.name)
 SELECT name_a, name_b, {r('i::double / u')} AS similarity FROM p WHERE i::double / u >= 0.5""")
def similar_part_names(t):
    from pyspark.sql import functions as F

    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    return ops.similar_names(t.raw("part").select(name.alias("name")), 0.5)
