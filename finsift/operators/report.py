"""Reports, one row for a company-year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsift.functions.columns import fenced
from finsift.operators.gateway import well_formed
from finsift.sources import prompts

POINT = 50


def comparison(found: DataFrame, names: list[str]) -> DataFrame:
    """Signed deviations side by side, a column for each indicator."""
    return found.groupBy("stock_code", "year").pivot("indicator", names).agg(F.first("signed"))


def items(found: DataFrame, checks: DataFrame) -> DataFrame:
    """Anomalies of both kinds in one form: (stock_code, year, source, name, severity, value)."""
    c = found.select("stock_code", "year", F.lit("C").alias("source"), F.col("indicator").alias("name"), "severity", F.round("actual", 6).alias("value"))
    b = checks.select("stock_code", "year", F.lit("B+").alias("source"), F.col("check_name").alias("name"), F.when(F.col("severity") >= 5, "extreme").otherwise("abnormal").alias("severity"), "value")
    return b.unionByName(c)


def explained(rows: DataFrame, attribution: DataFrame, evidence: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``rows`` of :func:`items` with their causes (cause, p; the likeliest first), what the
    report itself says (summary, page_number), and the company's own mean of the years
    before from ``history`` (historical_mean); null where nothing is known."""
    key = ["stock_code", "year", "name"]
    ordered = F.array_sort(F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("cause"))))
    causes = attribution.select("stock_code", "year", F.col("indicator").alias("name"), "source", F.transform(ordered, lambda e: F.struct(e["cause"].alias("cause"), (-e["p"]).alias("p"))).alias("causes"))
    said = evidence.select("stock_code", "year", F.col("indicator").alias("name"), "summary", "page_number")
    out = rows.join(causes, [*key, "source"], "left").join(said, key, "left")
    if history is None:
        return out.withColumn("historical_mean", F.lit(None).cast("double"))
    return out.join(history.select("stock_code", "year", F.col("indicator").alias("name"), F.round("historical_mean", 6).alias("historical_mean")), key, "left")


def points(impacts: DataFrame) -> DataFrame:
    """Skeleton of the bull and bear points: (stock_code, year, side, name, point),
    by the sign of the impact; a point is one line of POINT characters at most and
    ends with its source, the layer that found it."""
    side = F.when(F.col("impact") > 0, "bull").when(F.col("impact") < 0, "bear")
    tail = F.concat(F.lit("（来源："), F.col("source"), F.lit("）"))
    text = F.concat("name", F.lit("影响 "), F.round("impact", 2).cast("decimal(20,2)").cast("string"))
    text = F.concat(F.substring(text, F.lit(1), F.lit(POINT) - F.char_length(tail)), tail)
    return impacts.withColumn("side", side).where("side is not null").select("stock_code", "year", "side", "name", text.alias("point"))


def point_calls(scores: DataFrame, anomalies: DataFrame, peers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(stock_code, year, prompt_name, variables): a call for the wording of the points of
    each scored company-year, from its anomalies (:func:`explained`) and its peers."""
    key = ["stock_code", "year"]
    cause = F.concat(F.get("causes", F.lit(0))["cause"], F.lit("("), F.round(F.get("causes", F.lit(0))["p"], 2).cast("string"), F.lit(")"))
    page = F.concat(F.lit("p."), F.col("page_number").cast("string"))
    line = F.concat_ws(" ", "source", "name", F.col("value").cast("string"), "severity", cause, page)
    listed = anomalies.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("anomalies"))
    beside = peers.groupBy("stock_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer_code"))), lambda p: p["peer_code"]), ", ").alias("peer_comparison"))  # five
    rows = scores.join(listed, key, "left").join(beside, "stock_code", "left")
    if names is not None:
        rows = rows.join(names.groupBy("stock_code").agg(F.max("company_name").alias("company_name")), "stock_code", "left")
    company = F.coalesce("company_name", "stock_code") if names is not None else F.col("stock_code")
    values = {"company_name": company, "report_year": F.col("year"), "score": F.col("final_score"), "anomalies": F.col("anomalies"), "peer_comparison": F.col("peer_comparison")}
    return rows.select(*key, F.lit("e2_report").alias("prompt_name"), prompts.rendered("e2_report", values).alias("variables"))


def worded(answers: DataFrame, ruled: DataFrame) -> DataFrame:
    """(stock_code, year, side, name, point): the points of answers (stock_code, year,
    response) that have the form, of POINT characters and one line each, and those of
    ``ruled`` (:func:`points`) where a company-year has no such answer.  A point's name is
    its own text."""
    key = ["stock_code", "year"]
    read = answers.where(well_formed(F.lit("e2_report"), F.col("response"))).select(*key, F.from_json(fenced(F.col("response")), "bull array<string>, bear array<string>").alias("p"))
    told = read.where(F.col("p.bull").isNotNull() & ~F.exists(F.concat("p.bull", "p.bear"), lambda x: F.contains(x, F.lit("\n"))))
    of = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x.alias("point"))
    sides = told.select(*key, F.explode(F.concat(*[F.transform(f"p.{s}", of(s)) for s in ("bull", "bear")])).alias("x"))
    return sides.select(*key, "x.side", F.col("x.point").alias("name"), "x.point").unionByName(ruled.join(told.select(*key).distinct(), key, "left_anti"))


def too_long(rows: DataFrame, text: str, most: int = POINT) -> DataFrame:
    return rows.where((F.char_length(text) > most) | F.col(text).contains("\n"))


#: The report as JSON.
REPORT = (
    "overall struct<final_score:double,tier:string,c_impact:double,bplus_impact:double,peer_comparison:array<struct<peer_code:string,similarity:double>>>, "
    "core_anomalies array<struct<source:string,name:string,severity:string,value:double,probabilities:map<string,double>,summary:string,page_number:int,historical_mean:double>>, "
    "points struct<bull:array<string>,bear:array<string>>, message string"
)


def assemble(scores: DataFrame, anomalies: DataFrame, side_points: DataFrame, peers: DataFrame, blocked: DataFrame) -> DataFrame:
    """(stock_code, year, report): a JSON report with its three modules (REPORT), or
    the message of a blocked one.  Lists hold a company-year's own anomalies, of
    :func:`explained`, and its peers."""
    key = ["stock_code", "year"]
    fields = ["source", "name", "severity", "value", "causes", "summary", "page_number", "historical_mean"]
    listed = anomalies.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("core_anomalies"))
    sides = side_points.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("point")))).alias(s) for s in ("bull", "bear")])
    beside = peers.groupBy("stock_code").agg(F.array_sort(F.collect_list(F.struct("rank", "peer_code", "similarity"))).alias("peers"))  # five
    full = scores.join(listed, key, "left").join(sides, key, "left").join(beside, "stock_code", "left")
    one = lambda a: F.struct(*[a[f].alias(f) for f in fields[:4]], F.map_from_entries(a["causes"]).alias("probabilities"), a["summary"].alias("summary"), a["page_number"].alias("page_number"), a["historical_mean"].alias("historical_mean"))
    text = F.array().cast("array<string>")
    body = F.struct(
        F.struct("final_score", "tier", "c_impact", "bplus_impact", F.coalesce(F.transform("peers", lambda p: F.struct(p["peer_code"].alias("peer_code"), p["similarity"].alias("similarity"))), F.array().cast("array<struct<peer_code:string,similarity:double>>")).alias("peer_comparison")).alias("overall"),
        F.coalesce(F.transform("core_anomalies", one), F.array().cast("array<struct<source:string,name:string,severity:string,value:double,probabilities:map<string,double>,summary:string,page_number:int,historical_mean:double>>")).alias("core_anomalies"),
        F.struct(F.coalesce("bull", text).alias("bull"), F.coalesce("bear", text).alias("bear")).alias("points"),
    )
    done = full.select(*key, F.to_json(body).alias("report"))
    stopped = blocked.select(*key, F.to_json(F.struct("message")).alias("report"))
    return done.join(stopped.select(*key), key, "left_anti").unionByName(stopped)


def leaves(reports: DataFrame) -> DataFrame:
    """(stock_code, year, module, item, value, text): what reports say, read back from
    their JSON, a row for each leaf."""
    r = reports.select("stock_code", "year", F.from_json("report", REPORT).alias("r")).select("stock_code", "year", "r.*")
    none = F.lit(None)
    row = lambda module, item, value=none, text=none: F.struct(F.lit(module).alias("module"), item.cast("string").alias("item"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    name = lambda a: F.concat(a["source"], F.lit(":"), a["name"])
    o = F.col("overall")
    every = F.concat(
        F.when(o.isNotNull(), F.array(row("overall", F.lit("score"), o["final_score"], o["tier"]), row("overall", F.lit("C"), o["c_impact"]), row("overall", F.lit("B+"), o["bplus_impact"]))).otherwise(F.array(row("blocked", F.lit("message"), none, F.col("message")))),
        *[
            F.coalesce(x, F.array().cast("array<struct<module:string,item:string,value:double,text:string>>"))
            for x in (
                F.transform(o["peer_comparison"], lambda p: row("peer", p["peer_code"], p["similarity"])),
                F.transform("core_anomalies", lambda a: row("anomaly", name(a), a["value"], a["severity"])),
                F.flatten(F.transform("core_anomalies", lambda a: F.transform(F.map_entries(F.coalesce(a["probabilities"], F.create_map().cast("map<string,double>"))), lambda e: row("cause", F.concat(name(a), F.lit(":"), e["key"]), e["value"])))),
                F.transform("points.bull", lambda p: row("bull", F.regexp_extract(p, "^(.*)影响 ", 1), none, F.regexp_extract(p, "来源：(.*)）$", 1))),
                F.transform("points.bear", lambda p: row("bear", F.regexp_extract(p, "^(.*)影响 ", 1), none, F.regexp_extract(p, "来源：(.*)）$", 1))),
            )
        ],
    )
    return r.select("stock_code", "year", F.inline(every))
