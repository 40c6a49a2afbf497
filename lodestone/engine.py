"""Public API: search, results, get_metadata, read, export, link_references over stored tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cluster import removed, written
from lodestone.functions import text as tx
from lodestone.operators import cite, links, project, retrieve
from lodestone.operators import rank as rk
from lodestone.operators.state import RETENTION_DAYS, Operation, OperationStopped, Store, cached_search, detail_fresh, write_file, write_json
from lodestone.plans.expression import Expression, QueryError, as_expression, predicate, printed
from lodestone.plans.planner import Options, Plan, search_input
from lodestone.sources import records

INLINE_BYTES = 512 << 10
MAX_METADATA, MAX_RESULTS, MAX_EXPORT, SELECTED = 100, 100, 1000, 100


@dataclass
class SearchResult:
    """entries: rank, ref, score, eligible, selected; further tables of the run and its plan."""

    search_id: str
    plan: Plan
    options: Options
    entries: DataFrame
    hits: DataFrame
    coverage: DataFrame
    operation: Operation = field(default_factory=lambda: Operation("search"))
    ranked: DataFrame | None = None

    def output(self, papers: DataFrame, limit: int = 20, kind: str = "compact") -> dict:
        """What a client is shown first: counts, plan, coverage, and the first selected rows as {fields, rows}."""
        total = self.summary()
        chosen = self.entries.where("selected").orderBy("rank").limit(limit).select("ref", "rank")
        shown = project.view(papers.join(chosen, "ref"), kind).join(chosen, "ref").orderBy("rank").drop("rank")
        out = {k: total[k] for k in ("search_id", "candidates", "eligible", "selected")} | project.columnar(shown, limit)
        if self.ranked is not None:
            reasons = self.ranked.where("NOT eligible").groupBy(rk.exclusion_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per reason
            out |= {"not_selected": {r["reason"]: r["n"] for r in reasons}} if reasons else {}
        out["plan"] = plan_view(self.plan)
        out["coverage"] = project.columnar(self.coverage.orderBy("channel"), len(self.plan.channels) + 2)
        if (n := min(limit, total["selected"])) < total["selected"]:
            out["next_offset"] = n
        return out if self.operation.status in ("completed", "cached") else out | {"operation": self.operation.view()}

    def summary(self) -> dict:
        row = self.entries.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if("selected").alias("selected")).first()
        return {"search_id": self.search_id, "method": self.plan.method, "expression": [printed(c.expression) for c in self.plan.channels], **row.asDict()}


def plan_view(plan: Plan) -> dict:
    """Method and channels with their expressions in print."""
    rows = [[c.id, printed(c.expression), c.weight] for c in plan.channels]
    return {"method": plan.method, "channels": {"fields": ["channel", "expression", "weight"], "rows": rows}}


@dataclass
class _Run:
    """A search on its way: what its finished stages gave."""

    plan: Plan
    options: Options
    key: str
    as_of_year: int
    as_of: str | None
    op: Operation
    asked: dict = field(default_factory=dict)
    scanned: DataFrame | None = None
    pool: DataFrame | None = None
    read: DataFrame | None = None
    ranked: DataFrame | None = None
    saved: dict = field(default_factory=dict)
    """Table by name as it was last written, and where."""

    TABLES = ("scanned", "pool", "read", "ranked")

    @property
    def search_id(self) -> str:
        return self.op.id.replace("op_", "cs_")


def cache_key(options: Options, plan: Plan, sources: str) -> str:
    """What a search asks for; how much of it is shown does not count."""
    asked = {k: v for k, v in asdict(options).items() if k not in ("limit", "view", "freshness")}
    return hashlib.sha256(json.dumps([asked, [printed(c.expression) for c in plan.channels], sources], sort_keys=True).encode()).hexdigest()


class Engine:
    """Searches a papers table; close(), or leaving a with block, removes what its searches have written. root keeps entries of finished searches, runs and snapshots of texts.

    details (ref, parser, detail_at and the fields that a detail page adds) is what stands in for
    reading pages: a search takes from it for the papers that it would have read.
    """

    def __init__(self, spark: SparkSession, papers: DataFrame, sources: DataFrame | None = None, root: str | None = None, name: str = "papers", details: DataFrame | None = None):
        self.spark, self.papers, self.sources, self.name, self.details = spark, papers, sources, name, details
        self.store = Store(spark, root) if root else None
        self._runs: dict[str, _Run] = {}
        self._tables: list[DataFrame] = []

    # -- search --

    def search(self, query: str = "", concept_groups: list[list[str]] | None = None, expression: Expression | None = None, as_of_year: int = 2026, as_of: str | None = None, budget: int = 600, **options) -> SearchResult:
        """Concepts are ranked with feedback; an expression keeps the source's order.

        A page of a channel and a detail that is read cost one request each of the budget.
        """
        o, plan = search_input(query, concept_groups, expression, **options)
        key = cache_key(o, plan, self.name)
        if self.store and as_of and o.freshness == "prefer_cache" and (stored := self.store.read("searches")) is not None:
            if row := cached_search(stored, key, F.lit(as_of).cast("timestamp")).first():
                return self._stored(row["search_id"], plan, o)
        asked = {"query": query, "concept_groups": concept_groups, "expression": None if expression is None else asdict(expression), "options": options}
        return self._go_on(_Run(plan, o, key, as_of_year, as_of, Operation("search", budget), asked))

    def resume(self, search_id: str, extra: int = 200) -> SearchResult:
        """Goes on with a search whose budget ended, from the last stage that it finished, also in another process if the engine has a root."""
        run = self._runs.get(search_id) or self._loaded(search_id)
        if run is None:
            raise QueryError("CONTINUE_UNAVAILABLE", search_id)
        run.op = run.op.resumed(extra)
        return self._go_on(run)

    def _go_on(self, run: _Run) -> SearchResult:
        """The stages that a run has not finished; what one gives is kept for the next and for a resume."""
        self._runs[run.search_id] = run
        stages = [("retrieve", self._retrieve)]
        if run.plan.method != "structured":
            stages += [("pool", self._pool), ("enrich", self._enrich), ("feedback", self._feedback), ("enrich_feedback", self._enrich_feedback), ("rank", self._rank)]
        try:
            for name, step in stages:
                if name not in run.op.done:
                    with _stage(self.spark, run.op, name):
                        step(run)
                    self._save(run)
            run.op.status = "completed"
        except OperationStopped as e:
            run.op.status = "cancelled" if e.args[0] == "CANCELLED" else "partial"
        self._save(run)
        out = self._result(run)
        if run.op.status == "completed":
            del self._runs[run.search_id]
            if self.store and run.as_of:
                self.store.append("search_entries", out.entries.withColumn("search_id", F.lit(out.search_id)), out.search_id)
                row = self.spark.createDataFrame([(out.search_id, run.key)], "search_id string, cache_key string")
                self.store.append("searches", row.withColumn("ts", F.lit(run.as_of).cast("timestamp")), out.search_id)
        return out

    # -- runs that outlive their process --

    def _save(self, run: _Run) -> None:
        """Writes what a run has: the tables that are new since its last stage, then the manifest that names them."""
        if self.store is None:
            return
        folder = f"{self.store.root}/runs/{run.search_id}"
        for name in _Run.TABLES:
            df = getattr(run, name)
            if df is not None and run.saved.get(name, (None, ""))[0] is not df:
                path = f"{folder}/{len(run.op.done)}-{name}-{uuid.uuid4().hex[:8]}"
                df.write.parquet(path)
                run.saved[name] = df, path
        tables = {name: path for name, (_, path) in run.saved.items()}
        op = {k: v for k, v in asdict(run.op).items()}
        asked = run.asked | {"key": run.key, "as_of_year": run.as_of_year, "as_of": run.as_of}
        write_json(self.spark, folder, "manifest.json", {"asked": asked, "operation": op, "tables": tables, "saved_at": time.time()})

    def _manifest(self, search_id: str) -> dict | None:
        if self.store is None or not self.store.exists(f"runs/{search_id}/manifest.json"):
            return None
        return json.loads(self.spark.read.text(f"{self.store.root}/runs/{search_id}/manifest.json", wholetext=True).first()[0])

    def _loaded(self, search_id: str) -> _Run | None:
        """A run as its manifest has it."""
        found = self._manifest(search_id)
        if found is None:
            return None
        asked = found["asked"]
        expression = None if asked["expression"] is None else as_expression(asked["expression"])
        o, plan = search_input(asked["query"], asked["concept_groups"], expression, **asked["options"])
        op = found["operation"]
        op["progress"] = tuple(op["progress"]) if op["progress"] else None
        run = _Run(plan, o, asked["key"], asked["as_of_year"], asked["as_of"], Operation(**op), {k: asked[k] for k in ("query", "concept_groups", "expression", "options")})
        for name, path in found["tables"].items():
            df = self.spark.read.parquet(path)
            setattr(run, name, df)
            run.saved[name] = df, path
        if run.op.status == "running":  # its process ended
            run.op.status = "interrupted"
        return run

    def operations(self) -> list[dict]:
        """Views of the stored runs, the last saved first."""
        found = [(m["saved_at"], self._loaded(n).op) for n in (self.store.names("runs") if self.store else []) if (m := self._manifest(n)) is not None]
        return [op.view() | {"active_seconds": round(op.active_seconds, 3), "used": op.used, "id": op.id} for _, op in sorted(found, key=lambda x: -x[0])]

    def prune_operations(self, now: float | None = None) -> int:
        """Removes runs that were last saved more than RETENTION_DAYS ago; says how many."""
        limit, gone = (now or time.time()) - RETENTION_DAYS["operations"] * 86_400, 0
        for name in self.store.names("runs") if self.store else []:
            if (m := self._manifest(name)) is not None and m["saved_at"] < limit:
                self.store.delete(f"runs/{name}")
                self._runs.pop(name, None)
                gone += 1
        return gone

    def _scan(self, run: _Run, channels: list, max_pages: int) -> DataFrame:
        found = self._kept(retrieve.scan_all(self.papers, channels, [t for g in run.plan.concepts for t in g], sort=run.options.sort, max_pages=max_pages))
        pages = found.groupBy("channel").agg(F.max("page").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        run.op.charge(int(pages))
        return found

    def _retrieve(self, run: _Run) -> None:
        run.scanned = self._kept(retrieve.until_target(self._scan(run, run.plan.channels, run.options.max_pages), run.options.target))

    def _hits(self, run: _Run) -> DataFrame:
        return retrieve.hits(run.scanned, run.options.year_from, run.options.year_to)

    def _ranked(self, run: _Run) -> DataFrame:
        """The candidates by what is known of them by now."""
        return self._kept(rk.rank(self._known(run), run.plan, self._hits(run), self.sources, run.as_of_year))

    def _known(self, run: _Run) -> DataFrame:
        return self.papers if run.read is None else project.with_details(self.papers, run.read)

    def _pool(self, run: _Run) -> None:
        """Which candidates deserve a detail, by their preliminary rank."""
        run.pool = self._kept(rk.pool(self._ranked(run), run.options.metadata))

    def _read_details(self, run: _Run, refs: DataFrame) -> None:
        """Details of refs; those read lately by the present parser cost nothing."""
        if self.details is None or run.options.metadata == "basic":
            return
        fresh = F.lit(False) if run.as_of is None else detail_fresh("detail_at", F.col("parser"), records.PARSER_VERSION, F.lit(run.as_of).cast("timestamp"))
        found = self.details.join(refs.select("ref").distinct(), "ref", "left_semi")
        run.op.charge(found.where(~fresh).count())
        run.read = self._kept(found if run.read is None else run.read.join(found.select("ref"), "ref", "left_anti").unionByName(found))

    def _enrich(self, run: _Run) -> None:
        self._read_details(run, run.pool)

    def _feedback(self, run: _Run) -> None:
        more = rk.feedback_channels(self._ranked(run), run.plan) if run.options.mode != "precise" and run.options.metadata != "basic" else []
        if more:
            run.scanned = self._kept(run.scanned.unionByName(self._scan(run, more, 1)))

    def _enrich_feedback(self, run: _Run) -> None:
        """Of all candidates by now the best that have no detail yet."""
        if self.details is not None and run.options.metadata != "basic":
            best = rk.pool(self._ranked(run), run.options.metadata)
            self._read_details(run, best if run.read is None else best.join(run.read.select("ref"), "ref", "left_anti"))

    def _rank(self, run: _Run) -> None:
        run.ranked = self._ranked(run)

    def _result(self, run: _Run) -> SearchResult:
        """What a run has so far; a partial one is ranked by what it knows."""
        if run.scanned is None:
            none = self.spark.createDataFrame([], "ref string, rank long, score double, eligible boolean, selected boolean")
            hits = self.spark.createDataFrame([], "ref string, channel string, position long, weight double")
            return SearchResult(run.search_id, run.plan, run.options, none, hits, retrieve.coverage(hits.withColumn("page", F.lit(0))), run.op)
        hits, o = self._hits(run), run.options
        if run.plan.method == "structured":
            entries = hits.select("ref", F.col("position").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("eligible"), (F.col("position") <= SELECTED).alias("selected"))
            return SearchResult(run.search_id, run.plan, o, self._kept(entries), hits, retrieve.coverage(run.scanned), run.op)
        ranked = run.ranked if run.ranked is not None else self._ranked(run)
        ordered = rk.ordered(ranked)
        if o.metadata == "basic":
            entries = ordered.select("ref", "rank", "score", "eligible", (F.col("rank") <= SELECTED).alias("selected"))
        else:
            chosen = rk.select(ranked, SELECTED).select("ref", F.lit(True).alias("selected"))
            entries = ordered.join(chosen, "ref", "left").select("ref", "rank", "score", "eligible", F.coalesce("selected", F.lit(False)).alias("selected"))
        return SearchResult(run.search_id, run.plan, o, self._kept(entries), hits, retrieve.coverage(run.scanned), run.op, ranked)

    def _kept(self, df: DataFrame) -> DataFrame:
        """A phase's result, written so that later phases and retries start from it."""
        out = written(df, "search")
        self._tables.append(out)
        return out

    def close(self) -> None:
        """Removes the tables of this engine's searches; what a root keeps stays."""
        removed(*self._tables)
        self._tables, self._runs = [], {}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _stored(self, search_id: str, plan: Plan, o: Options) -> SearchResult:
        entries = self.store.read("search_entries").where(F.col("search_id") == search_id).drop("search_id")
        none = self.spark.createDataFrame([], "ref string, channel string, position long, weight double")
        return SearchResult(search_id, plan, o, entries, none, retrieve.coverage(none.withColumn("page", F.lit(0))), Operation("search", status="cached"))

    def results(self, found: SearchResult | str, scope: str = "selected", offset: int = 0, limit: int = 50, view: str = "compact") -> DataFrame:
        """A page of stored entries with their papers, in rank order."""
        if not 0 <= limit <= MAX_RESULTS:
            raise QueryError("INVALID_LIMIT", f"0 to {MAX_RESULTS} rows")
        if isinstance(found, str):
            stored = self.store.read("search_entries") if self.store else None
            if stored is None or not stored.where(F.col("search_id") == found).limit(1).count():
                raise QueryError("SEARCH_NOT_FOUND", found)
            entries = stored.where(F.col("search_id") == found).drop("search_id")
        else:
            entries = found.entries
        page = project.page_of(entries, scope, offset, limit)
        return page.select("ref", "rank").join(project.view(self.papers, view), "ref").orderBy("rank")

    # -- records --

    def get_metadata(self, refs: list[str] | None = None, titles: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
        """Records in request order; unknown refs are left out, titles must name one paper."""
        asked = list(dict.fromkeys(refs or []))
        if len(asked) + len(titles or []) > MAX_METADATA:
            raise QueryError("BATCH_TOO_LARGE", f"at most {MAX_METADATA} records")
        if titles:
            status = project.title_status(self.spark.createDataFrame([(t,) for t in titles], "title string"), self.papers).collect()
            for r in status:
                if r["status"] != "one":
                    raise QueryError("DOCUMENT_NOT_FOUND" if r["status"] == "not_found" else "IDENTITY_AMBIGUOUS", r["title"])
            asked += [r["ref"] for r in status if r["ref"] not in asked]
        wanted = self.spark.createDataFrame(list(enumerate(asked)), "pos int, ref string")
        return project.in_order(wanted, project.fields(self.papers, fields or self.papers.columns)).orderBy("pos")

    def where(self, expression: Expression) -> DataFrame:
        """All papers that an expression matches."""
        return self.papers.where(predicate(expression))

    # -- texts --

    def read(self, snapshots: DataFrame, ref: str, section: str = "", offset: int = 0, limit: int = 8000) -> DataFrame:
        """One page of the newest text of a paper: (ref, text, offset, total_characters, next_offset).

        snapshots has ref, ts, text and sections (level, title, offset, length).
        """
        newest = snapshots.where(F.col("ref") == ref).orderBy(F.desc("ts")).limit(1)
        row = newest.select(F.col("sections")).first()
        if row is None:
            raise QueryError("SNAPSHOT_NOT_FOUND", ref)
        start, end = F.lit(0), F.char_length("text")
        if section:
            same = [s for s in row["sections"] or [] if " ".join(s["title"].split()).lower() == " ".join(section.split()).lower()]
            if len(same) != 1:
                raise QueryError("SECTION_AMBIGUOUS" if same else "SECTION_NOT_FOUND", section)
            start, end = F.lit(int(same[0]["offset"])), F.least(F.char_length("text"), F.lit(int(same[0]["offset"] + same[0]["length"])))
        first = F.least(end, start + offset)
        last = F.least(end, first + limit)
        return newest.select(
            "ref", F.substr("text", (first + 1).cast("int"), (last - first).cast("int")).alias("text"), F.lit(offset).alias("offset"), (end - start).alias("total_characters"),
            F.when(last < end, F.lit(offset) + last - first).alias("next_offset"),
        )

    # -- output --

    def export(self, refs: list[str], style: str = "gbt7714", template: str = "", path: str | None = None) -> DataFrame:
        """(text, count) of all citations in request order; with a path the text is written there as one file, never over another."""
        if len(refs) > MAX_EXPORT:
            raise QueryError("BATCH_TOO_LARGE", f"at most {MAX_EXPORT} records")
        wanted = self.spark.createDataFrame(list(enumerate(refs)), "pos int, ref string")
        papers = project.in_order(wanted, self.papers)
        style = cite.ALIASES.get(style, style)
        out = cite.joined(cite.citations(papers, style, template, "pos", cite.listed), style)
        if path is not None:  # at most MAX_EXPORT citations
            folder, _, name = path.rpartition("/")
            write_file(self.spark, folder, name, (out.first()["text"] or "").encode())
        elif (out.select(F.octet_length("text")).first()[0] or 0) > INLINE_BYTES:
            raise QueryError("OUTPUT_TOO_LARGE", "give a path")
        return out

    def link_references(self, text: str) -> tuple[str, DataFrame]:
        """The text with links, and (title, status, ref) of each marked title."""
        if len(text.encode()) > links.MAX_BYTES:
            raise QueryError("INPUT_TOO_LARGE", "at most 512 KiB")
        if len(links.reference_spans(text)) > links.MAX_TITLES:
            raise QueryError("TOO_MANY_REFERENCES", f"at most {links.MAX_TITLES} titles")
        docs = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        spans = [(0, k, a, b, t) for k, (a, b, t) in enumerate(links.reference_spans(text))]
        found = self.spark.createDataFrame(spans, "doc_id long, span long, start long, end long, title string")
        keys = found.select(tx.title_key("title").alias("key")).distinct()
        near = self.papers.withColumn("key", tx.title_key("title")).join(keys, "key", "left_semi").drop("key")
        linked = links.link(found, near)
        return links.rendered(docs, linked).first()["text"], linked.select("span", "title", "status", "ref").orderBy("span")


class _stage:
    """Tags the jobs of a phase with its operation, so that it can be cancelled."""

    def __init__(self, spark: SparkSession, op: Operation, name: str):
        self.spark, self.op, self.name = spark, op, name

    def __enter__(self) -> None:
        self.began = time.monotonic()
        self.op.start(self.spark, self.name)

    def __exit__(self, kind, *problem) -> None:
        self.op.active_seconds += time.monotonic() - self.began
        self.op.finish(self.spark, self.name, failed=kind is not None)
