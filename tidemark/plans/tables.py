"""The library's input tables, derived from the given test tables.

Only the registered queries and the bench use this module. Every view reads its whole base
table; the oracle builds the same views in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.session import apply_settings, written

BASE_PATH = "/binlog/"


def mod(c: str, n: int) -> Column:
    return F.col(c) % n


def div(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _asked(answers: DataFrame) -> DataFrame:
    return answers.select("cluster", "observer", "peer", "seed_rank").distinct()


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = apply_settings(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    # Archive

    @cached_property
    def change_stream(self) -> DataFrame:
        """The change log as a stream of the files of its base table."""
        source = self.spark.readStream.schema(self.read("events").schema).option("pathGlobFilter", "events.parquet")
        events = source.parquet(self.dir)
        return self._changes(events.withColumn("ts", F.col("ts").cast("timestamp")))

    @cached_property
    def change_log(self) -> DataFrame:
        return self._changes(self.events)

    def _changes(self, events: DataFrame) -> DataFrame:
        return events.select(
            text("a", mod("user_id", 4)).alias("archive_id"),
            text("n", mod("user_id", 8)).alias("lineage"),
            (div("event_id", 250) + 1).alias("seq"),
            mod("event_id", 250).alias("pos"),
            "ts",
            F.col("user_id").alias("key"),
            F.when(F.col("event_type") == "error", "delete")
            .when(F.col("event_type") == "signup", "insert")
            .otherwise("upsert")
            .alias("op"),
            F.col("value").alias("image"),
        )

    @cached_property
    def change_log_late(self) -> DataFrame:
        """Some rows carry a stamp 20 h ahead, so a stop is a prefix and not a filter."""
        late = (F.col("seq") * 250 + F.col("pos")) % 40 == 7
        ahead = F.col("ts") + F.expr("interval 20 hours")
        return self.change_log.withColumn("ts", F.when(late, ahead).otherwise(F.col("ts")))

    @cached_property
    def segments(self) -> DataFrame:
        found = self.change_log.groupBy("archive_id", "lineage", "seq").agg(
            F.min_by("ts", "pos").alias("first_ts"), F.max_by("ts", "pos").alias("last_ts"), F.min("pos").alias("first_pos")
        )
        within = lambda lo, hi: (F.col("first_ts") >= lo) & (F.col("first_ts") < hi)
        lost = ((F.col("archive_id") == "a2") & within("2024-01-07", "2024-01-10")) | (
            (F.col("archive_id") == "a1") & within("2024-01-22", "2024-01-25")
        )
        pending = (F.col("archive_id") == "a3") & (F.col("first_ts") >= "2024-01-20")
        return found.withColumns(
            {
                "name": F.format_string("binlog.%06d", "seq"),
                "status": F.when(lost, "lost").when(pending, "pending").otherwise("uploaded"),
            }
        )

    @cached_property
    def archived(self) -> DataFrame:
        return self.segments.where(F.col("status") == "uploaded")

    @cached_property
    def active(self) -> DataFrame:
        return self.segments.groupBy("lineage").agg(F.max("seq").alias("active_seq"))

    @cached_property
    def ledger(self) -> DataFrame:
        """Every upload is recorded; of the losses only those of even segments are, so far."""
        reported = (F.col("status") == "uploaded") | ((F.col("status") == "lost") & (F.col("seq") % 2 == 0))
        return self.segments.where(reported).select("lineage", "name", "status")

    @cached_property
    def disk(self) -> DataFrame:
        return self.segments.where(F.col("status") != "lost").select("lineage", "seq", "name")

    @cached_property
    def fulls(self) -> DataFrame:
        """One backup per lineage and day, at the day's first change, stamped with its hour."""
        first = self.change_log.groupBy("archive_id", "lineage", F.to_date("ts").alias("day")).agg(
            F.min(F.struct("seq", "pos", "ts")).alias("first")
        )
        taken = F.date_trunc("hour", "first.ts")
        return first.select(
            "archive_id",
            "lineage",
            text("binlog/server-", F.col("lineage"), "/full/", F.date_format(taken, "yyyyMMddHH"), ".sql.gz").alias("dump_key"),
            taken.alias("taken_at"),
            F.format_string("binlog.%06d", "first.seq").alias("start_file"),
            F.col("first.seq").alias("start_seq"),
            F.col("first.pos").alias("start_pos"),
        )

    @cached_property
    def targets(self) -> DataFrame:
        days = self.change_log.select("archive_id", F.to_date("ts").alias("day")).distinct()
        return days.select(
            "archive_id",
            text(F.col("archive_id"), "/", F.col("day")).alias("request_id"),
            (F.col("day").cast("timestamp") - F.expr("interval 12 hours") + F.expr("interval 500 milliseconds")).alias("target"),
        )

    @cached_property
    def objects(self) -> DataFrame:
        """Keys of backups and shipped segments; lost segments leave keys of other shapes."""
        at = text("binlog/server-", F.col("lineage"))
        dumps = self.fulls.select(
            "archive_id",
            F.explode(F.array("dump_key", F.regexp_replace("dump_key", r"\.sql\.gz$", ".meta.json"))).alias("key"),
        )
        shipped = self.archived.select("archive_id", F.concat(at, F.lit("/binlog/"), "name").alias("key"))
        strays = self.segments.where(F.col("status") == "lost").select(
            "archive_id",
            F.explode(
                F.array(
                    F.concat(F.lit("binlog/server-/full/"), "name"),
                    F.concat(F.lit("binlog2/server-"), "lineage", F.lit("/binlog/"), "name"),
                    F.concat(F.lit("x/"), "name"),
                )
            ).alias("key"),
        )
        return dumps.unionByName(shipped).unionByName(strays)

    @cached_property
    def backup_texts(self) -> DataFrame:
        """Metadata objects of the backups; those of even days in archive a2 are torn."""
        meta = F.to_json(
            F.struct(
                X.format_rfc3339_millis(F.col("taken_at")).alias("taken_at"),
                F.col("start_file").alias("binlog_file"),
                F.col("start_pos").alias("binlog_pos"),
                F.lit("other").alias("server_uuid"),
                F.lit("8.0").alias("mysql_version"),
            )
        )
        torn = (F.col("archive_id") == "a2") & (F.dayofmonth("taken_at") % 2 == 0)
        return self.fulls.select(
            "archive_id",
            F.regexp_replace("dump_key", r"\.sql\.gz$", ".meta.json").alias("key"),
            F.when(torn, F.substring(meta, 1, 20)).otherwise(meta).alias("text"),
        )

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.read("customer").select(
            text("n", mod("c_custkey", 8)).alias("lineage"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("image")
        )

    # Membership. Five users form a cluster; a round is a day, or a week for member views.

    @cached_property
    def member_views(self) -> DataFrame:
        day = F.unix_date(F.to_date("ts"))
        last = self.events.groupBy(
            div("user_id", 5).alias("cluster"),
            F.floor(day / 7).alias("round"),
            text("m", mod("user_id", 5)).alias("observer"),
            text("m", mod("event_id", 5)).alias("member_id"),
        ).agg(F.max(F.struct("event_id", "event_type", "value")).alias("e"))
        return last.select(
            "cluster",
            "round",
            "observer",
            "member_id",
            F.when(F.col("e.value") >= 1, F.concat(F.lit("host-"), "member_id")).alias("host"),
            member_state(F.col("e.event_type")).alias("state"),
            F.when(F.col("e.event_id") % 3 == 0, "PRIMARY").otherwise("SECONDARY").alias("role"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """What each node said of itself: its last event of the day decides everything."""
        last = self.events.groupBy(
            div("user_id", 5).alias("cluster"),
            F.unix_date(F.to_date("ts")).cast("bigint").alias("round"),
            mod("user_id", 5).cast("int").alias("seed_rank"),
        ).agg(F.max(F.struct("event_id", "event_type", "value", "ts")).alias("e"))
        node = text("m", F.col("seed_rank"))
        own = F.when(F.col("e.value") > 100, text(",\n ", node, ":1")).otherwise("")
        source = text(F.when(F.col("seed_rank") % 2 == 0, "C").otherwise("c"), F.col("cluster"))
        progress = (F.col("round") - 19723) * 4 + F.floor(F.hour("e.ts") / 6) + 1
        state = member_state(F.col("e.event_type"))
        nth = lambda n: F.col("e.event_id") % n
        return last.select(
            "cluster",
            "round",
            node.alias("node"),
            "seed_rank",
            state.alias("state"),
            F.when(nth(3) == 0, "PRIMARY").otherwise("SECONDARY").alias("role"),
            (state.isin("ONLINE", "RECOVERING") & (F.col("round") % 3 == 0)).alias("group_active"),
            F.when(F.col("e.value") < 1, None)
            .when(F.col("e.value").between(3, 8), " ")
            .when(nth(61) == 7, text(source, ":", progress + 3, "-", progress))
            .when(nth(61) == 17, text(source, ":1-", progress, "-9"))
            .when(nth(61) == 27, text(source, ":0-", progress))
            .when(nth(61) == 37, text(":1-", progress))
            .otherwise(F.concat(text(source, ":1-", progress), own))
            .alias("txn_set"),
            (nth(4) == 0).alias("prelog"),
            (progress % 3).alias("generation"),
            F.when(F.col("e.value") >= 2, text(F.when(F.col("seed_rank") % 2 == 0, "U").otherwise("u"), F.col("cluster"), "-", F.col("seed_rank") % 3)).alias("uuid"),
            F.when(nth(5) != 0, text("g", nth(2))).alias("group_name"),
            (nth(7) == 0).alias("pinned"),
            (nth(3) == 1).alias("fresh"),
            (nth(10) != 0).alias("checked"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        return self._answers(self.reports, ["group_active", "state", "role", "txn_set", "prelog", "generation", "uuid", "group_name"])

    def _answers(self, reports: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Polls between the nodes of a cluster, the last of each day, joined with the peer's report."""
        peer = ((mod("user_id", 5) + 1 + mod("event_id", 4)) % 5).cast("int")
        last = self.events.groupBy(
            div("user_id", 5).alias("cluster"),
            F.unix_date(F.to_date("ts")).cast("bigint").alias("round"),
            text("m", mod("user_id", 5)).alias("observer"),
            peer.alias("seed_rank"),
        ).agg(F.max(F.struct("event_id", "event_type")).alias("e"))
        polls = last.select(
            "cluster", "round", "observer", text("m", F.col("seed_rank")).alias("peer"), "seed_rank",
            F.when(F.col("e.event_type") == "click", "unreachable")
            .when((F.col("e.event_type") == "error") & (F.col("e.event_id") % 2 == 0), "not_ready")
            .otherwise("state")
            .alias("heard"),
            (F.col("e.event_id") % 6 == 0).alias("early"),
        )
        # An early answer was given before the peer wrote transactions of its own.
        said = reports.select("cluster", "round", F.col("node").alias("peer"), "checked", *fields)
        answer = (
            F.when(F.col("heard") != "state", F.col("heard"))
            .when(F.col("checked").isNull(), "unreachable")
            .when(~F.col("checked"), "not_ready")
            .otherwise("state")
        )
        return (
            polls.join(said, ["cluster", "round", "peer"], "left")
            .withColumn("answer", answer)
            .withColumn("txn_set", F.when(F.col("early"), F.regexp_replace("txn_set", r",\s*m\d:1", "")).otherwise(F.col("txn_set")))
            .select(
                "cluster", "round", "observer", "peer", "seed_rank", "answer",
                *[F.when(F.col("answer") == "state", F.col(c)).alias(c) for c in fields],
            )
        )

    @cached_property
    def declared(self) -> DataFrame:
        """The peers a node is told to ask: all it ever asks."""
        return _asked(self.answers)

    def stored_polls(self, *fields: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``answers``, ``reports`` and ``declared`` with these ``fields`` of what a node says, ``txn_set`` among them.

        Each is made once and stored, for queries that read them several times.
        """
        reports = written(self.reports.select("cluster", "round", "node", "seed_rank", "checked", *fields))
        answers = written(self._answers(reports, fields))
        return answers, reports, _asked(answers)

    @cached_property
    def node_configs(self) -> DataFrame:
        """One seed list per supplier, naming itself and two neighbours in changing case and spacing."""
        host = lambda n: text("host-", F.col("s_suppkey") + n)
        seeds = F.concat(host(1), F.lit(":3306, "), F.upper(host(0)), F.lit(":3306,, "), host(2), F.lit(" "))
        declared = F.when(F.col("s_acctbal") > 8000, F.concat(host(1), F.lit(","), host(2))).otherwise(seeds)
        return self.read("supplier").select(F.col("s_suppkey").alias("node"), host(0).alias("self"), declared.alias("seeds"))

    @cached_property
    def progress_parts(self) -> DataFrame:
        part = F.when(F.col("event_type") == "signup", "copy").otherwise("received")
        rows = self.events.select(
            F.col("user_id").alias("node"),
            F.unix_date(F.to_date("ts")).cast("bigint").alias("round"),
            part.alias("part"),
            text(F.col("event_type"), ":", F.floor(F.col("value") / 20)).alias("detail"),
        )
        executed = self.reports.where(F.col("txn_set").isNotNull()).select(
            (F.col("cluster") * 5 + F.col("seed_rank")).alias("node"), "round", F.lit("executed").alias("part"), F.col("txn_set").alias("detail")
        )
        return rows.unionByName(executed)

    # Polls of single nodes: an event is a poll of its user

    @cached_property
    def polls(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            F.col("user_id").alias("node"),
            F.unix_micros("ts").alias("at_us"),
            "event_id",
            F.when(kind == "error", "gone").otherwise("exists_or_unknown").alias("verdict"),
            F.when(kind == "click", "OFFLINE").otherwise(member_state(kind)).alias("state"),
            F.floor(F.col("value") / 50).cast("string").alias("signature"),
            F.when(F.col("event_id") % 3 == 0, "PRIMARY").otherwise("SECONDARY").alias("role"),
            F.when(kind == "purchase", "ready")
            .when(kind == "view", "planned_stop")
            .otherwise("start")
            .alias("event"),
            F.when(kind != "error", kind.isin("view", "purchase", "signup")).alias("primary_up"),
            kind.isin("view", "purchase", "signup").alias("passed"),
            (kind == "error").alias("attempt"),
            "value",
        )

    # Telemetry

    @cached_property
    def telemetry(self) -> DataFrame:
        kind = F.col("event_type")
        node = text("m", F.col("user_id"))
        role = lambda n: F.when(F.col("event_id") % n == 0, "PRIMARY").otherwise("SECONDARY")
        return self.events.select(
            "event_id",
            "ts",
            F.when(kind == "signup", "NodeStarted")
            .when(kind == "click", "RoleChanged")
            .when(kind == "error", "ProcessDied")
            .when(kind == "purchase", "NoPrimary")
            .otherwise("ComponentError")
            .alias("type"),
            node.alias("node"),
            role(2).alias("role"),
            role(2).alias("old_role"),
            role(3).alias("new_role"),
            F.lit("server").alias("process"),
            F.when(F.col("value") >= 10, F.floor(F.col("value")).cast("int")).alias("exit_code"),
            F.when(F.col("value") > 90, F.array(F.lit("edge"), node)).otherwise(F.array(node)).alias("backends"),
            F.lit("archiver").alias("component"),
            F.col("props").alias("error"),
            text("step ", F.col("event_id") % 4).alias("context"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        value = F.col("value")
        return self.events.select(
            "ts",
            F.when(value < 10, 503).when(value < 15, 400).when(value < 20, 204).otherwise(200).alias("status"),
            F.when(F.col("event_type") == "error", F.lit('{"errors": []}'))
            .when(F.col("event_type") == "click", F.lit("errors: none"))
            .otherwise(F.lit('{"data": true}'))
            .alias("body"),
        )

    @cached_property
    def edge_lines(self) -> DataFrame:
        """One statistics line per event; a poll is an hour of a cluster."""
        middle = F.repeat(F.lit(","), 16)
        server = F.when(F.col("event_type") == "view", "BACKEND").otherwise(text("server-", F.col("user_id")))
        status = F.when(F.col("value") > 80, "UP 1/2").when(F.col("value") > 30, "DOWN").otherwise("UP")
        proxy = F.when(F.col("event_type") == "click", "reads").otherwise("primary_backend")
        line = F.concat(proxy, F.lit(","), server, middle, status, F.lit(",,"))
        return self.events.select(
            text(div("user_id", 5), "@", F.date_format("ts", "yyyyMMddHH")).alias("poll"),
            F.when(F.col("value") < 5, F.lit("primary_backend,short,UP")).otherwise(line).alias("line"),
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        """A structured log line per segment of the archive; the shipped ones are no loss."""
        lost = F.col("status") == "lost"
        message = F.when(lost, F.concat(F.lit("log lost from disk before upload: "), "name")).otherwise("log uploaded")
        line = F.to_json(F.struct(F.lit("INFO").alias("level"), message.alias("message"), F.col("name").alias("file")))
        torn = F.when(F.col("status") == "pending", "not json").otherwise(line)
        return self.segments.select("lineage", torn.alias("line"))

    @cached_property
    def volumes(self) -> DataFrame:
        """A volume per order, and a spare one that no restore ever touched."""
        both = F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey") - 1))
        return self.read("orders").select(both.alias("volume"))

    @cached_property
    def markers(self) -> DataFrame:
        """Markers of all orders: open ones are in progress, some are torn."""
        orders = self.read("orders")
        status = F.when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed")
        day = F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")
        marker = F.to_json(F.struct(status.alias("status"), day.alias("target_time"), day.alias("updated_at")))
        return orders.select(
            F.col("o_orderkey").alias("volume"),
            F.when(F.col("o_totalprice") < 100000, F.substring(marker, 1, 12))
            .when(F.col("o_totalprice") < 120000, "")
            .otherwise(marker)
            .alias("marker_text"),
        )

    # Transaction sets: what six replicas hold of the line items

    @cached_property
    def txn_intervals(self) -> DataFrame:
        lines = self.read("lineitem")
        bulk, paid = F.col("l_quantity") > 5, F.col("l_discount") > 0.01
        owners = F.array_compact(
            F.array(
                F.lit("all"),
                F.lit("copy"),
                F.when(bulk, "bulk"),
                F.when(paid, "paid"),
                F.when(bulk & paid, "both"),
            )
        )
        return lines.select(
            F.explode(owners).alias("owner"),
            F.col("l_returnflag").alias("source"),
            F.col("l_orderkey").alias("lo"),
            (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("hi"),
        )

    @cached_property
    def owner_pairs(self) -> DataFrame:
        names = ["all", "both", "bulk", "copy", "none", "paid"]
        pairs = ", ".join(f"('{a}', '{b}')" for a in names for b in names if a < b)
        return self.spark.sql(f"SELECT * FROM VALUES {pairs} AS p(a, b)")

    @cached_property
    def txn_texts(self) -> DataFrame:
        """A set text per line item, with white space, a list of spans, a single and a tagged source; a seventh have a bad part."""
        key = F.col("l_orderkey")
        bad = F.element_at(
            F.array(*map(F.lit, ["w:9-8,", "w:1-2-3,", "w:0,", ":4,", "w,", "w:1:-2,", "w:x:y:2,"])), (key % 7).cast("int") + 1
        )
        body = text(
            F.when(F.col("l_linenumber") == 7, bad).otherwise(""), " ", F.col("l_returnflag"), ":", key, "-", key + F.col("l_linenumber"), ":", key + 20, ",\n", F.col("l_linestatus"), ":tag:", key, ":old:", key + 7, "-", key + 9
        )
        return self.read("lineitem").select(
            "l_suppkey", F.explode(F.array(F.when(F.col("l_tax") == 0, "").otherwise(body))).alias("txn_set")
        )


def member_state(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "ERROR")
        .when(event_type == "signup", "RECOVERING")
        .when(event_type == "click", "UNREACHABLE")
        .otherwise("ONLINE")
    )
