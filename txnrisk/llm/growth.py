"""Links among rows that share keys, without comparing all pairs under a key.

In some rounds every row is compared with one row drawn under each of its keys, as far as they are not joined yet, so that
large groups of near copies grow together at a cost that is linear in their size. Under a key whose rows are all joined no
further pair can change a component. Under the others, every pair from different components is compared that a bound does not
refute: rows outside the key's largest component with all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.llm.components import components
from txnrisk.llm.shared import written

#: Rounds of comparisons with drawn rows, and how many of the nearest of these are confirmed for each row.
ROUNDS, NEAREST = 3, 4


def joining_links(members: DataFrame, carry: list[str], distance: Callable[[str, str], Column], possible: Callable[[str, str], Column], confirmed: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Confirmed links (a, b) that join all rows which any confirmed link joins.

    ``members``: key, sid, home and the ``carry`` columns. Two rows are compared if they share a key and one of them is at
    home there. ``distance`` (of two aliases) says which drawn rows are tried first; pairs for which ``possible`` is false are
    no links and are dropped inside the join. ``confirmed`` gives the links among pairs (a, b).
    """
    labelled = members.withColumn("component", F.col("sid"))
    found = tested = None
    for number in range(rounds):
        draw = F.struct(F.xxhash64("key", "sid", F.lit(number)).alias("h"), "sid", "component", *carry)
        drawn = labelled.filter("home").groupBy("key").agg(F.min(draw).alias("d")).select("key", "d.sid", "d.component", *[f"d.{c}" for c in carry])
        both = labelled.alias("x").join(drawn.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & possible("x", "y"))
        pairs = both.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), F.col("x.sid").alias("of"), distance("x", "y").alias("distance")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        # A row has at most as many of these as it has keys.
        nth = F.row_number().over(Window.partitionBy("of").orderBy("distance", "a", "b"))
        chosen = written(pairs.withColumn("nth", nth).filter(F.col("nth") <= NEAREST).select("a", "b").distinct())
        more = written(confirmed(chosen))
        found, tested = (more, chosen) if found is None else (found.unionByName(more), tested.unionByName(chosen))
        if more.isEmpty():
            break
        joined = components(found).withColumnRenamed("node", "sid")
        labelled = written(members.join(joined, "sid", "left").select(*members.columns, F.coalesce("component", "sid").alias("component")))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    split = written(labelled.join(parts.filter("parts > 1").select("key", F.col("top.component").alias("main")), "key"))
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.home") | F.col("y.home"))
    across &= (F.col("x.sid") < F.col("y.sid")) | (F.col("y.component") == F.col("y.main"))
    rest = split.filter("component != main").alias("x").join(split.alias("y"), across & possible("x", "y"))
    rest = rest.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    return found.unionByName(confirmed(written(rest)))
