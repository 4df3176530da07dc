"""op10_decontaminate: the benchmark items that documents contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.containment import find_items


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
_SHINGLES = r"""
  SELECT DISTINCT id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM
    (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}))
"""
ORACLES = {
    "op10_decontaminate": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n.n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(n.n) AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) * 10 >= any_value(n.n) * 8
"""
}
