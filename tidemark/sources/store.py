"""Runs and what is known of them, as Parquet tables and a log of numbered commits.

A writer puts its rows into folders of its own, a folder a table, which nobody reads yet. Then one rename publishes a commit
that says which folders of which tables are there from now on, which are gone, and what the rows of the runs are. Readers
take what the commits name, so they meet every step whole or not at all: finishing a run, pruning many, scrubbing all
tables. Folders that no commit names any more are deleted after it is published; a writer that is lost leaves some that
vacuum() finds. Two writers never publish the same number; the later one takes the next. Run ids are strings of any form,
and a column of the rows. Behaviors are written once, by the first run that has them. Feedback is append-only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import redact_text

SCHEMA_VERSION = 3
RUNS = "run_id string, project string, context string, command string, cwd string, started_at_ms long, wall_ms long, exit_code int, lines long, interrupted boolean, uncompared long, stats_pruned boolean, evidence_pruned boolean, version int"
FEEDBACK = "at_ms long, kind string, run_id string, behavior_id string, signal_id string, note string"
LOG = f"n long, runs array<struct<{', '.join(f.replace(' ', ': ') for f in RUNS.split(', '))}>>, adds array<struct<table: string, commit: string, run_id: string>>, removes array<string>"
#: Tables of a run by what pruning takes them with.
TIERS = {"stats": ("aggregates", "aggregate_measures", "aggregate_scopes", "aggregate_scope_sums", "facts", "cells", "signals", "run_sources", "run_baselines"), "evidence": ("exemplars", "captures")}
TABLES = (*TIERS["stats"], *TIERS["evidence"])
#: Columns that hold lines as they came.
TEXTS = {"exemplars": "line", "captures": "line", "feedback": "note"}
MOST_SIGNALS = 1_000


class Pruned(LookupError):
    """A run that was asked for had what was asked for pruned."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def _put(self, df: DataFrame, table: str) -> str:
        """Writes rows to a folder that no commit names yet; returns its name."""
        commit = "c-" + uuid.uuid4().hex  # never a number to readers
        df.write.parquet(f"{self.root}/{table}/commit={commit}")
        return commit

    def _publish(self, runs: list[dict], adds: list[tuple[str, str, str | None]] = (), removes: list[str] = ()) -> int:
        """One commit, whole or not at all; removes names folders. Returns its number."""
        fields = [f.split()[0] for f in RUNS.split(", ")]
        entry = {"runs": [{f: r.get(f) for f in fields} for r in runs], "adds": [{"table": t, "commit": c, "run_id": r} for t, c, r in adds], "removes": list(removes)}
        folder, fs = self._path(f"{self.root}/log")
        fs.mkdirs(folder)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        while True:
            n = 1 + max([int(name.split(".")[0]) for name in self._names(f"{self.root}/log") if name[:1].isdigit()], default=0)
            beside, _ = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
            out = fs.create(beside, True)
            out.write(bytearray((json.dumps(entry | {"n": n}) + "\n").encode()))
            out.close()
            none = self.spark._sc._gateway.new_array(rename, 1)
            none[0] = rename.NONE
            try:
                hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, self._path(f"{self.root}/log/{n:012d}.json")[0], none)
                return n
            except Exception as e:  # another writer had this number first
                fs.delete(beside, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    def _log(self) -> DataFrame:
        """All commits."""
        named = [n for n in self._names(f"{self.root}/log") if n.endswith(".json") and n[:1].isdigit()]
        return self.spark.read.schema(LOG).json(f"{self.root}/log/*.json") if named else self.spark.createDataFrame([], LOG)

    def _live(self, *tables: str) -> DataFrame:
        """table, commit, run_id of the folders that hold the rows of tables (of all, if none is named)."""
        log = self._log()
        adds = log.select(F.explode("adds").alias("a")).select("a.*")
        gone = log.select(F.explode("removes").alias("commit")).distinct()
        return (adds.where(F.col("table").isin(*tables)) if tables else adds).join(gone, "commit", "left_anti").select("table", "commit", "run_id")

    def _rows(self, table: str, live: DataFrame) -> DataFrame:
        """Rows of a table's folders that live names, by a join that prunes folders; FileNotFoundError if there is none."""
        one = live.where(F.col("table") == table).select("commit")
        first = one.first()
        if first is None:
            raise FileNotFoundError(f"{table} was never written")
        schema = self.spark.read.parquet(f"{self.root}/{table}/commit={first[0]}").schema
        whole = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())])).parquet(f"{self.root}/{table}")
        return whole.join(F.broadcast(one), "commit", "left_semi").drop("commit")  # one row a folder, as Spark's own list of files has

    def begin(self, run: dict) -> None:
        """A run's row before anything of it is known; it is no finished run yet."""
        self._publish([run | {"version": 0}])

    def finish(self, run: dict, tables: dict[str, DataFrame], most_signals: int = MOST_SIGNALS) -> None:
        """Writes a run's tables (and behaviors: those not known yet), and publishes them and its row at once. Interrupted runs
        keep no signals; a flood of signals is counted, not kept."""
        for name in tables:
            if name not in (*TABLES, "behaviors"):
                raise ValueError(f"no table is named {name}")
        signals = tables.get("signals")
        if signals is not None:
            found = signals.limit(most_signals + 1).count()
            if run.get("interrupted") or found > most_signals:
                run = run | {"uncompared": None if run.get("interrupted") else signals.count()}
                tables = {k: v for k, v in tables.items() if k != "signals"}
        adds = []
        for name, df in tables.items():
            if name == "behaviors":
                adds.append((name, self._put(self._unknown(df.drop("run_id").dropDuplicates(["behavior_id"])), name), None))
            else:
                adds.append((name, self._put(df.withColumn("run_id", F.lit(run["run_id"])), name), run["run_id"]))
        self._publish([run | {"version": 1}], adds)

    def _unknown(self, behaviors: DataFrame) -> DataFrame:
        """Those not stored yet: of the stored ones, only the ids that are asked for take part."""
        try:
            stored = self._rows("behaviors", self._live("behaviors")).select("behavior_id")
        except FileNotFoundError:
            return behaviors
        known = stored.join(behaviors.select("behavior_id"), "behavior_id", "left_semi").distinct()
        return behaviors.join(known, "behavior_id", "left_anti")

    def _latest(self) -> DataFrame:
        rows = self._log().select("n", F.explode("runs").alias("r"))
        return rows.groupBy("r.run_id").agg(F.max_by("r", "n").alias("r")).select("r.*")

    def runs(self) -> DataFrame:
        """Finished runs."""
        return self._latest().where("version > 0")

    def unfinished(self) -> DataFrame:
        """Runs that began and were never finished."""
        return self._latest().where("version = 0")

    def usable(self, context: str) -> DataFrame:
        """Finished runs of a context that may be a baseline, newest first."""
        return self.runs().where((F.col("context") == context) & ~F.coalesce("interrupted", F.lit(False)) & ~F.coalesce("stats_pruned", F.lit(False))).orderBy(F.desc("started_at_ms"), F.desc("run_id"))

    def table(self, name: str, run_ids: list[str] | None = None) -> DataFrame:
        """Rows of finished runs: of those named, or of all that still have them. A run that is named must have them: one that
        isn't known is a LookupError, one whose rows were pruned is Pruned; never is it read as empty."""
        tier = "evidence" if name in TIERS["evidence"] else "stats"
        gone = F.coalesce(f"{tier}_pruned", F.lit(False))
        live = self._live(name)
        if run_ids is not None:
            known = {r["run_id"]: r["gone"] for r in self.runs().where(F.col("run_id").isin(run_ids)).select("run_id", gone.alias("gone")).collect()}
            for r in run_ids:
                if r not in known:
                    raise LookupError(f"no finished run is named {r}")
                if known[r]:
                    raise Pruned(f"the {tier} of {r} were pruned")
            if live.limit(1).count():
                live = live.where(F.col("run_id").isin(run_ids))
                if not live.limit(1).count():
                    return self._rows(name, self._live(name)).limit(0)
        return self._rows(name, live)

    def behaviors(self) -> DataFrame:
        """Each behavior once."""
        return self._rows("behaviors", self._live("behaviors")).dropDuplicates(["behavior_id"])

    def resolve(self, prefix: str) -> str:
        """The behavior that a prefix of at least four hex digits names; none or two is an error."""
        if len(prefix) < 4 or any(c not in "0123456789abcdef" for c in prefix):
            raise ValueError("a prefix has four to sixteen hex digits")
        found = self.behaviors().where(F.col("behavior_id").startswith(prefix)).select("behavior_id").limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{prefix} names {'no' if not found else 'more than one'} behavior")
        return found[0][0]

    def stats(self, run_ids: list[str] | None = None) -> DataFrame:
        """aggregates with what their behaviors are; where none noted its first place, the first kept line's."""
        rows = self.table("aggregates", run_ids)
        if "first_stream" in rows.columns and self._live("exemplars").limit(1).count():
            kept = self.table("exemplars").groupBy("run_id", "behavior_id").agg(F.min_by(F.struct("stream", "seq"), "position").alias("kept"))
            rows = rows.join(kept, ["run_id", "behavior_id"], "left").withColumns({"first_seq": F.coalesce(F.when(F.col("first_stream").isNotNull(), F.col("first_seq")), "kept.seq"), "first_stream": F.coalesce("first_stream", "kept.stream")}).drop("kept")
        return rows.join(self.behaviors(), "behavior_id")

    def signals(self, run_ids: list[str] | None = None) -> DataFrame:
        """signals with what their behaviors are, and the name of the behavior that their scope is, if it is one."""
        named = self.behaviors()
        scope = named.select(F.col("behavior_id").alias("scope_id"), F.col("template").alias("scope_template"))
        return self.table("signals", run_ids).join(named.withColumnRenamed("kind", "behavior_kind"), "behavior_id").join(scope, "scope_id", "left")

    def counts(self) -> dict[str, int]:
        """How many finished runs, contexts and behaviors there are."""
        row = self.runs().agg(F.count("*"), F.count_distinct("context")).first()
        return {"runs": row[0], "contexts": row[1], "behaviors": self.behaviors().count() if self._live("behaviors").limit(1).count() else 0}

    def prune(self, plan: DataFrame) -> int:
        """Applies a plan (run, action) of outcomes.retention_plan in one commit: stats go with their evidence. Returns how many
        runs it took something of. Folders are deleted once no reader is told of them any more."""
        plan = plan.select(F.col("run").cast("string").alias("run_id"), "action")
        todo = [r.asDict() for r in self.runs().join(plan, "run_id").where("not coalesce(stats_pruned, false) and not (action = 'evidence' and coalesce(evidence_pruned, false))").collect()]  # a row a run to prune
        if not todo:
            return 0
        action = {r["run_id"]: r.pop("action") for r in todo}
        tiers = self.spark.createDataFrame([(r, t) for r, a in action.items() for t in (*TIERS["evidence"], *(TIERS["stats"] if a == "stats" else ()))], "run_id string, table string")
        gone = [(r["table"], r["commit"]) for r in self._live().join(tiers, ["run_id", "table"], "left_semi").collect()]
        self._publish([r | {"evidence_pruned": True, "stats_pruned": action[r["run_id"]] == "stats", "version": r["version"] + 1} for r in todo], removes=[c for _, c in gone])
        for table, commit in gone:
            self._delete(f"{self.root}/{table}/commit={commit}")
        return len(todo)

    def feedback(self, rows: list[dict], mode: str = "secrets") -> None:
        """Appends all rows or none; notes without the secrets in them."""
        names = [f.split()[0] for f in FEEDBACK.split(", ")]
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FEEDBACK)
        self._publish([], [("feedback", self._put(df.withColumn("note", redact_text(F.col("note"), mode)).coalesce(1), "feedback"), None)])

    def feedback_rows(self) -> DataFrame:
        try:
            return self._rows("feedback", self._live("feedback"))
        except FileNotFoundError:
            return self.spark.createDataFrame([], FEEDBACK)

    def scrub(self, mode: str = "secrets") -> None:
        """Takes secrets out of lines and notes that an older store kept as they came: all tables anew, and one commit that puts
        them in the place of the old ones. Done again, or after it was lost, it changes nothing else."""
        suffix, adds, removes = "-" + uuid.uuid4().hex[:8], [], []
        for table, text in TEXTS.items():
            live = self._live(table)
            named = [(r["commit"], r["run_id"]) for r in live.collect()]  # a row a folder
            if named:
                schema = self._rows(table, live).schema
                whole = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())])).parquet(f"{self.root}/{table}")
                rows = whole.join(F.broadcast(live.select("commit")), "commit", "left_semi").withColumn(text, redact_text(F.col(text), mode))
                rows.withColumn("commit", F.concat("commit", F.lit(suffix))).select(*schema.names, "commit").write.mode("append").partitionBy("commit").parquet(f"{self.root}/{table}")
                there = {n.removeprefix("commit=") for n in self._names(f"{self.root}/{table}")}
                adds += [(table, c + suffix, r) for c, r in named if c + suffix in there]  # a folder without rows has no other
                removes += [(table, c) for c, _ in named if c + suffix in there]
        if adds:
            self._publish([], adds, [c for _, c in removes])
            for table, commit in removes:
                self._delete(f"{self.root}/{table}/commit={commit}")

    def vacuum(self) -> int:
        """Deletes folders that no commit names, while nobody else writes. Returns how many."""
        live = {(r["table"], f"commit={r['commit']}") for r in self._live().collect()}
        dead = [(t, n) for t in (*TABLES, "behaviors", "feedback") for n in self._names(f"{self.root}/{t}") if n.startswith("commit=") and (t, n) not in live]
        for table, name in dead:
            self._delete(f"{self.root}/{table}/{name}")
        return len(dead)


def documents(rows: DataFrame) -> DataFrame:
    """A JSON document a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("document"))


def report(ranked: DataFrame) -> DataFrame:
    """A JSON document a run of ranked signals: its groups in order, each with its head and all of its signals."""
    one = F.struct("place", "behavior", "kind", "measure", "current", "confidence", "tier")
    groups = ranked.groupBy("context", "run", "group_rank").agg(F.array_sort(F.collect_list(one)).alias("signals"))
    runs = groups.groupBy("context", "run").agg(F.array_sort(F.collect_list(F.struct("group_rank", F.col("signals")[0]["behavior"].alias("head"), "signals"))).alias("groups"))
    return runs.select("context", "run", F.to_json(F.struct("context", "run", F.size("groups").alias("changes"), "groups")).alias("document"))
