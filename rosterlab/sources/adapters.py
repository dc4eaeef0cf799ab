"""Give star-schema tables the shapes the roster operators expect.

Every attribute is derived from column values by Spark; nothing is sampled. ``Tables`` reads
lazily, so a query touches only the tables and columns it uses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..skew import first_per_key

AS_OF = "2024-01-01"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def first_lines(self) -> DataFrame:
        """The first line of every order, by (line number, supplier, part): that triple is unique in an order."""
        lines = self.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        return first_per_key(lines, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"])

    @cached_property
    def teams(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("team_code"), F.col("n_name").alias("team"), F.col("r_name").alias("category")
        )

    @cached_property
    def players(self) -> DataFrame:
        last = self.orders.groupBy("o_custkey").agg(
            F.max("o_orderdate").cast("date").alias("last_date"),
            F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"),
        )
        months = (F.lit(12) * (F.lit(20) + F.abs(F.floor("c_acctbal")) % F.lit(18))).cast("int")
        own, other = F.col("c_nationkey"), F.lit(24) - F.col("c_nationkey")
        birth = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), own).when(F.col("c_mktsegment") != "HOUSEHOLD", other)
        return (
            self.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
            .withColumn("birth_key", birth)
            .join(self.nation.select(F.col("n_nationkey").alias("birth_key"), F.col("n_name").alias("birth_country")), "birth_key", "left")
            .select(
                F.col("c_custkey").alias("player_id"),
                F.col("c_name").alias("display_name"),
                F.when(F.col("last_status") != "P", F.add_months("last_date", -months)).alias("date_of_birth"),
                "birth_country",
                F.col("c_mktsegment").alias("primary_position"),
            )
        )

    @cached_property
    def entries(self) -> DataFrame:
        bal = F.col("c_acctbal")
        return self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("player_id"),
            F.col("c_nationkey").alias("team_code"),
            F.col("n_name").alias("team"),
            F.col("c_mktsegment").alias("position_group"),
            F.when(bal >= 0, F.floor(bal).cast("int")).alias("caps"),
            F.when(bal >= 9000, "removed").otherwise("active").alias("squad_status"),
            (bal < -500).alias("is_replacement"),
        )

    @cached_property
    def clubs(self) -> DataFrame:
        return (
            self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("club_id"),
                F.col("s_name").alias("club_name"),
                F.col("n_name").alias("country"),
                F.when(F.col("s_acctbal") >= 0, F.col("r_name")).alias("league"),
                F.when(F.col("s_acctbal") >= 0, F.concat_ws("-", "n_name", F.floor(F.col("s_acctbal") / 2500).cast("int"))).alias("city"),
                F.when(F.col("s_acctbal") >= 1000, F.col("s_suppkey") * 37 % 180 - 90).cast("double").alias("lat"),
                F.when(F.col("s_acctbal") >= 1000, F.col("s_suppkey") * 91 % 360 - 180).cast("double").alias("lon"),
            )
        )

    @cached_property
    def links(self) -> DataFrame:
        """One club per player: the supplier on the player's first order line."""
        per_order = self.orders.join(self.first_lines, F.col("o_orderkey") == F.col("l_orderkey"))
        per_player = per_order.groupBy("o_custkey").agg(F.min_by("l_suppkey", "o_orderkey").alias("club_id"))
        return per_player.join(self.entries.select("player_id", "team"), F.col("o_custkey") == F.col("player_id")).select(
            "player_id", "club_id", "team"
        )

    @cached_property
    def player_stats(self) -> DataFrame:
        lines = self.lineitem.groupBy("l_orderkey").agg(
            F.sum("l_quantity").alias("qty"),
            F.count_if(F.col("l_returnflag") == "R").alias("r"),
            F.count_if(F.col("l_returnflag") == "A").alias("a"),
            F.count_if(F.col("l_discount") >= 0.09).alias("y"),
            F.count_if((F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07)).alias("red"),
            F.count_if((F.col("l_discount") >= 0.09) & (F.col("l_tax") == 0)).alias("ind"),
        )
        return (
            self.orders.select("o_orderkey", "o_custkey")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("player_id"))
            .agg(
                F.sum("qty").cast("long").alias("minutes_played"),
                F.sum("r").alias("goals"),
                F.sum("a").alias("assists"),
                F.sum("y").alias("yellow_cards"),
                F.sum("red").alias("red_cards"),
                F.sum("ind").alias("indirect_red_cards"),
            )
        )

    @cached_property
    def matches(self) -> DataFrame:
        """One match per order: customer's nation at home, the first line's supplier's nation away."""
        scores = self.lineitem.groupBy("l_orderkey").agg(
            F.count_if(F.col("l_returnflag") == "A").cast("int").alias("home_score"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("away_score"),
            F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("l_suppkey"),
        )
        home = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select("c_custkey", F.col("n_name").alias("home_team"), F.col("r_name").alias("city"))
        away = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", F.col("n_name").alias("away_team")
        )
        shootout = (F.col("home_score") == F.col("away_score")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        even = F.floor("o_totalprice") % 2 == 0
        return (
            self.orders.join(scores, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(home, F.col("o_custkey") == F.col("c_custkey"))
            .join(away, F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .select(
                F.col("o_orderkey").alias("match_id"),
                F.col("o_orderdate").cast("date").alias("match_date"),
                F.col("o_orderpriority").alias("stage"),
                "home_team", "away_team", "home_score", "away_score",
                F.when(shootout, F.when(even, 4).otherwise(3)).alias("home_pens"),
                F.when(shootout, F.when(even, 3).otherwise(4)).alias("away_pens"),
                F.col("o_orderstatus").alias("stadium"),
                "city",
                F.when(F.col("home_score").isNull(), "scheduled").otherwise("played").alias("status"),
            )
        )

    @cached_property
    def doc_lines(self) -> DataFrame:
        """Every line of every document: (doc_id, pos, value), whole texts."""
        # the outer form splits each text once; the plain one would also split it to test for emptiness
        lines = F.posexplode_outer(F.split("text", "\n")).alias("pos", "value")
        return self.documents.filter("text is not null").select("doc_id", "lang", "source", lines)

    @cached_property
    def knockout(self) -> DataFrame:
        """Eight-player brackets over all customers: neighbours by key meet, the larger balance goes on.

        Round r of bracket b pairs the best of two blocks of 2**(r-1) customers, so every match is
        an aggregate over a block; the goals are the balance digits.
        """
        c = self.customer.select("c_custkey", F.floor(F.col("c_acctbal") + 1000).cast("long").alias("power"))
        rounds = None
        for r, stage in enumerate(["Quarter-final", "Semi-final", "Final"], start=1):
            best = c.groupBy(F.shiftright("c_custkey", r - 1).alias("block")).agg(
                F.max_by(F.struct("c_custkey", "power"), F.struct("power", "c_custkey")).alias("w")
            )
            sides = best.groupBy(F.shiftright("block", 1).alias("slot")).agg(
                F.max(F.when(F.col("block") % 2 == 0, F.col("w"))).alias("h"),
                F.max(F.when(F.col("block") % 2 == 1, F.col("w"))).alias("a"),
            ).filter("h is not null and a is not null")
            goals = lambda s: (F.col(f"{s}.power") / 2000).cast("int")
            level = goals("h") == goals("a")
            stronger = (F.col("h.power") > F.col("a.power")) | ((F.col("h.power") == F.col("a.power")) & (F.col("h.c_custkey") > F.col("a.c_custkey")))
            one = sides.select(
                F.shiftright("slot", 3 - r).alias("tournament"),
                F.concat_ws("-", F.lit(r), "slot").alias("match_id"),
                F.lit(stage).alias("stage"),
                F.lit(r).alias("round_no"),
                F.col("h.c_custkey").alias("home_team"),
                F.col("a.c_custkey").alias("away_team"),
                goals("h").alias("home_score"),
                goals("a").alias("away_score"),
                F.when(level, F.when(stronger, 5).otherwise(4)).alias("home_pens"),
                F.when(level, F.when(stronger, 4).otherwise(5)).alias("away_pens"),
            )
            rounds = one if rounds is None else rounds.unionByName(one)
        return rounds
