"""The analysis of statements as named stages over frames.

Each stage says what frames it needs and adds some.  Stages whose frames are there
run side by side.  Every frame a stage adds is written as Parquet in a folder named by
a fingerprint of what it was made from, and a manifest is written once all are there; a
later run takes what has a manifest with the same fingerprint, and runs the rest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.operators import deviation, guide, indicators, logic_checks, macro, mapping, naming, peers, reasoning, report, scoring, validation
from finsift.sources import config, settings
from finsift.sources import reports as files
from finsift.sources.config import GROUP, PARENT

Frames = dict[str, DataFrame]
#: A stage's function, what it needs, and what it reads besides where that is there.
STAGES: dict[str, Callable[[Frames, How], Frames]] = {}
NEEDS: dict[str, set[str]] = {}
MAY: dict[str, set[str]] = {}
KEY = ["stock_code", "year", "indicator", "source"]
#: Versions of the stages' own code: raise one when its frames come to mean something else.
VERSION = 1


@dataclass
class How:
    """How a run asks a language model: a provider for each partition (see
    :mod:`finsift.operators.gateway`), the folder of its answers, and more for the gateway.
    Without a provider, guides, causes and points go by rule."""

    provider: Callable | None = None
    cache: str | None = None
    options: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        return "model" if self.provider else "rule"


def stage(name: str, *needs: str, may: tuple[str, ...] = ()):
    def add(f: Callable[[Frames, How], Frames]):
        STAGES[name], NEEDS[name], MAY[name] = f, set(needs), set(may)
        return f

    return add


@stage("headers", "documents")
def _headers(f: Frames, how: How) -> Frames:
    """What a guide may read: the cells of grids without an amount."""
    return {"headers": guide.headers(guide.grid_cells(f["documents"]))}


@stage("names", "documents", "headers", may=("aliases",))
def _names(f: Frames, how: How) -> Frames:
    """Aliases known so far, and sure ones for names that are new."""
    said = f["headers"].select(naming.cleaned(F.col("text")).alias("raw_name"))
    new = mapping.unmapped(files.raw_names(f["documents"]).unionByName(said))
    if "aliases" not in f:
        return {"learned": naming.suggestions(new, 0.8)}
    old = f["aliases"]
    return {"learned": old.unionByName(naming.suggestions(new.join(old.select("raw_name"), "raw_name", "left_anti"), 0.8).select(*old.columns))}


@stage("guide", "headers", "learned")
def _guide(f: Frames, how: How) -> Frames:
    """Where the amounts of known names are in the grids, by rule or by a model."""
    if how.provider:
        answers = reasoning.answered(guide.guide_calls(f["headers"]), how.provider, how.cache, **how.options)
        return {"guide": guide.answered_guide(f["headers"], answers)}
    return {"guide": guide.header_guide(f["headers"], f["learned"])}


@stage("facts", "documents", "guide", "learned")
def _facts(f: Frames, how: How) -> Frames:
    """Extracted documents to facts and sections; runs where there are documents.  What
    a grid says counts before a list of names and amounts."""
    at = guide.period_facts(guide.grid_cells(f["documents"]), f["guide"].where("standard_name is not null"))
    gridded, listed = guide.statement_facts(at), files.facts_of(f["documents"], f["learned"])
    key = ["stock_code", "year", "report_type", "standard_name"]
    facts = gridded.unionByName(listed.join(gridded.select(*key), key, "left_anti"))
    bad = at.where("reason is not null").select("stock_code", "year", "statement", "raw_name", "text", "reason")
    return {"facts": facts, "periods": at, "unreadable": files.unreadable(f["documents"], f["learned"]).unionByName(bad), "sections": files.report_sections(f["documents"])}


@stage("peers", "tags")
def _peers(f: Frames, how: How) -> Frames:
    return {"peers": peers.top_peers(peers.tag_sets(f["tags"]))}


@stage("statements", "facts")
def _statements(f: Frames, how: How) -> Frames:
    group = mapping.statements(mapping.of_type(f["facts"], GROUP), config.standard_names(), ("stock_code", "industry", "year"))
    return {"group": group, "parent": mapping.statements(mapping.of_type(f["facts"], PARENT), ["Monetary_Funds"])}


@stage("gate", "group")
def _gate(f: Frames, how: How) -> Frames:
    good, blocked = validation.gate(f["group"])
    return {"good": good, "blocked": blocked}


@stage("checks", "good", "parent")
def _checks(f: Frames, how: How) -> Frames:
    return {"anomalies": logic_checks.anomalies(f["good"], f["parent"])}


@stage("indicators", "good")
def _indicators(f: Frames, how: How) -> Frames:
    return {"indicators": indicators.long_form(indicators.derive(f["good"]), config.indicator_names())}


@stage("deviation", "indicators", "peers")
def _deviation(f: Frames, how: How) -> Frames:
    return {"outliers": deviation.outliers(deviation.deviations(f["indicators"], peers.peer_values(f["indicators"], f["peers"])))}


@stage("history", "indicators", "anomalies")
def _history(f: Frames, how: How) -> Frames:
    """Each company's own mean of the years before, years with an anomaly left out."""
    bad = f["anomalies"].select("stock_code", "year").distinct()
    return {"history": peers.history(f["indicators"], bad).where("n_years > 0")}


def asked_about(outliers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(stock_code, year, indicator, source, actual, multiple) of all that needs a cause."""
    c = outliers.select("stock_code", "year", "indicator", F.lit("C").alias("source"), "actual", "multiple")
    b = anomalies.select("stock_code", "year", F.col("check_name").alias("indicator"), F.lit("B+").alias("source"), F.col("value").alias("actual"), F.lit(None).cast("double").alias("multiple"))
    return c.unionByName(b)


@stage("evidence", "outliers", "anomalies", may=("sections",))
def _evidence(f: Frames, how: How) -> Frames:
    """What each company's own report says, where its sections are known."""
    if "sections" in f:
        return {"evidence": reasoning.evidence(asked_about(f["outliers"], f["anomalies"]), f["sections"], config.keywords())}
    none = "stock_code string, year int, indicator string, summary string, source_text string, page_number int, is_vague boolean"
    return {"evidence": f["outliers"].sparkSession.createDataFrame([], none)}


@stage("context", "good", "tags", may=("searches", "macro_facts"))
def _context(f: Frames, how: How) -> Frames:
    """What was known of each industry at the end of each year: ``macro_facts`` (industry,
    published, text), and those a model finds in ``searches`` (industry, published,
    search_query, search_results)."""
    told = [f["macro_facts"].select("industry", "published", "text")] if "macro_facts" in f else []
    if "searches" in f and how.provider:
        answers = reasoning.answered(macro.fact_calls(f["searches"]), how.provider, how.cache, **how.options)
        told.append(macro.facts_of_answers(answers).select("industry", "published", "text"))
    spark = f["good"].sparkSession
    facts = spark.createDataFrame([], "industry string, published date, text string")
    for t in told:
        facts = facts.unionByName(t)
    return {"context": macro.contexts(f["good"], f["tags"], facts)}


@stage("reasoning", "outliers", "anomalies", "evidence", "context", may=("explanations",))
def _reasoning(f: Frames, how: How) -> Frames:
    """Both paths by a model where there is one.  Else by rule from ``explanations``
    (stock_code, year, indicator, source, path1, path2, is_vague, conflict), or without
    that from the evidence alone; what has none is left to "other"."""
    asked = asked_about(f["outliers"], f["anomalies"])
    if how.provider:
        return {"attribution": reasoning.dual_path(asked, f["evidence"], f["context"], how.provider, how.cache, **how.options)}
    every = asked.select(*KEY)
    if "explanations" in f:
        known = every.join(f["explanations"], KEY, "left")
    else:
        said = f["evidence"].select("stock_code", "year", "indicator", F.col("summary").alias("path1"), "is_vague")
        known = every.join(said, ["stock_code", "year", "indicator"], "left").withColumns({"path2": F.lit(None).cast("string"), "conflict": F.lit(False)})
    return {"attribution": reasoning.rule_probabilities(known.fillna(False, ["is_vague", "conflict"]))}


@stage("scores", "good", "outliers", "anomalies", "attribution")
def _scores(f: Frames, how: How) -> Frames:
    c, b = scoring.deviation_impacts(f["outliers"], f["attribution"]), scoring.check_impacts(f["anomalies"], f["attribution"])
    return {"scores": scoring.scores(f["good"], c, b), "impacts": named_impacts(c, b)}


def named_impacts(c: DataFrame, b: DataFrame) -> DataFrame:
    """(stock_code, year, name, source, impact) of both kinds."""
    one = lambda df, name, source: df.select("stock_code", "year", F.col(name).alias("name"), F.lit(source).alias("source"), "impact")
    return one(c, "indicator", "C").unionByName(one(b, "check_name", "B+"))


@stage("reports", "scores", "outliers", "anomalies", "attribution", "evidence", "impacts", "peers", "blocked", "history", "facts")
def _reports(f: Frames, how: How) -> Frames:
    rows = report.explained(report.items(f["outliers"], f["anomalies"]), f["attribution"], f["evidence"], f["history"])
    points = report.points(f["impacts"])
    if how.provider:
        asked = report.point_calls(f["scores"], rows, f["peers"], f.get("facts") if "company_name" in f["facts"].columns else None)
        points = report.worded(reasoning.answered(asked, how.provider, how.cache, **{**how.options, "strict": True}), points)
    return {"reports": report.assemble(f["scores"], rows, points, f["peers"], f["blocked"])}


def content(df: DataFrame) -> str:
    """A digest of a frame's rows in any order, and of its columns."""
    told = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    # maps can't be hashed, so rows are hashed as JSON
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(h)).first()
    return hashlib.sha256(json.dumps([told, n, str(total)]).encode()).hexdigest()


class Work:
    """The folder of a run's frames: a folder for each stage, in it one for each
    fingerprint, in that the frames and, last, their manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _text(self, path: str) -> str | None:
        fs, where = self._files(path)
        return self.spark.read.text(path, wholetext=True).first()["value"] if fs.exists(where) else None

    def stored(self, name: str, fingerprint: str) -> Frames | None:
        """The frames of a stage, or None if they weren't all written."""
        at = f"{self.folder}/{name}/{fingerprint}"
        manifest = self._text(f"{at}/manifest.json")
        if manifest is None:
            return None
        return {made: self.spark.read.parquet(f"{at}/{made}") for made in json.loads(manifest)["frames"]}

    def store(self, name: str, fingerprint: str, frames: Frames, inputs: dict[str, str]) -> Frames:
        at = f"{self.folder}/{name}/{fingerprint}"
        for made, df in frames.items():
            df.write.mode("overwrite").parquet(f"{at}/{made}")
        text = json.dumps({"stage": name, "frames": sorted(frames), "inputs": inputs}, sort_keys=True)
        fs, temporary = self._files(f"{at}/_manifest.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, done = self._files(f"{at}/manifest.json")
        fs.rename(temporary, done)  # one step, so that a manifest is whole or isn't there
        return self.stored(name, fingerprint) or {}


def run(spark: SparkSession, inputs: Frames, work: str, start: str | None = None, skip: tuple[str, ...] = (), how: How | None = None) -> Frames:
    """All frames after all stages, less ``skip``, for all companies at once.  ``inputs``
    has tags and either documents or facts, and may have explanations, aliases,
    macro_facts and searches.  A stage that lacks a frame, since one before it was
    skipped, is left out.

    A stage whose frames are in ``work``, made from inputs and settings of the same
    content, isn't run again: its frames are read.  From the stage ``start`` on all run
    again.  Changed inputs rerun the stages that depend on them and no other; what an
    interrupted run left half-written has no manifest and is written anew.
    """
    if start is not None and start not in STAGES:
        raise KeyError(start)
    how, folder, names = how or How(), Work(spark, work), list(STAGES)
    frames, prints = dict(inputs), {name: content(df) for name, df in inputs.items()}
    again = set(names[names.index(start) :]) if start else set()
    held = hashlib.sha256(f"{VERSION} {settings.fingerprint()} {how.fingerprint()}".encode()).hexdigest()
    left = [n for n in names if n not in skip]

    def done(name: str) -> tuple[Frames, str]:
        read = {n: prints[n] for n in sorted((NEEDS[name] | MAY[name]) & prints.keys())}
        fingerprint = hashlib.sha256(json.dumps([name, held, read]).encode()).hexdigest()[:32]
        found = None if name in again else folder.stored(name, fingerprint)
        if found is None:
            found = folder.store(name, fingerprint, STAGES[name](dict(frames), how), read)
        return found, fingerprint

    def ready(name: str) -> bool:
        # what a stage may read is waited for while a stage that makes it is still to run
        coming = {m for n in (*left, *running.values()) if n != name and NEEDS[n] <= possible for m in MAKES.get(n, ())}
        return NEEDS[name] <= frames.keys() and not (MAY[name] & coming - frames.keys())

    possible = set(frames)
    for n in left:
        if NEEDS[n] <= possible:
            possible |= MAKES.get(n, set())
    with ThreadPoolExecutor(4) as pool:
        running: dict = {}
        while True:
            for name in [n for n in left if ready(n)]:
                left.remove(name)
                running[pool.submit(done, name)] = name
            if not running:
                return frames
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                del running[future]
                made, fingerprint = future.result()
                frames |= made
                prints |= {n: f"{fingerprint}/{n}" for n in made}


#: Frames that other stages may, but need not, read, by the stage that makes them.
MAKES = {
    "headers": {"headers"},
    "names": {"learned"},
    "guide": {"guide"},
    "facts": {"facts", "periods", "unreadable", "sections"},
}
