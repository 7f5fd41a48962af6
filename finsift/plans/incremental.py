"""Scores after some company-years have changed, without scoring the others again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsift.operators import deviation, indicators, logic_checks, peers
from finsift.plans import stages
from finsift.plans.stages import Frames, How
from finsift.sources import config
from finsift.sources.work import staged

KEY = ["stock_code", "year"]


def touched(changed: DataFrame) -> DataFrame:
    """(stock_code, year) whose indicators may differ: the changed ones and, by their
    growth, the years after."""
    return changed.select("stock_code", F.explode(F.array("year", F.col("year") + 1)).alias("year")).distinct()


def reached(changed: DataFrame, peer_list: DataFrame) -> DataFrame:
    """(stock_code, year) whose scores may differ: what is touched, and whoever has a
    touched company for a peer."""
    hit = touched(changed)
    who = peer_list.select(F.col("stock_code").alias("__who"), F.col("peer_code").alias("stock_code")).join(hit, "stock_code")
    return hit.union(who.select("__who", "year")).distinct()


def rescore(old: Frames, facts: DataFrame, how: How | None = None) -> Frames:
    """The frames scores, outliers, anomalies, attribution and blocked of a run with its
    ``facts`` of some company-years replaced, and ``rescored``, the company-years that were
    scored again.

    ``old`` has a run's facts, tags, peers and those frames, and what else its reasoning
    read (explanations, sections, macro_facts); ``facts`` has all facts of each company-year
    that changed.  Peers depend on tags alone, so they stay.  Facts are read of the
    company-years reached, their peers, and the years before, and of no others; all other
    rows are taken over as they are.  Results equal those of a whole run.
    """
    how = how or How()
    changed = facts.select(*KEY).distinct()
    reach = staged(reached(changed, old["peers"]), "reach")
    with_peers = staged(reach.union(old["peers"].select("stock_code", F.col("peer_code").alias("__p")).join(reach, "stock_code").select("__p", "year")).distinct(), "with_peers")
    needed = with_peers.union(with_peers.select("stock_code", F.col("year") - 1)).distinct()
    kept = old["facts"].join(changed, KEY, "left_anti").select(*facts.columns)
    f: Frames = {n: old[n] for n in ("tags", "peers", "explanations", "sections", "macro_facts", "searches") if n in old}
    f["facts"] = staged(kept.unionByName(facts).join(needed, KEY, "left_semi"), "facts")
    f |= stages.STAGES["statements"](f, how)
    f |= stages.STAGES["gate"](f, how)
    f["good"] = staged(f["good"], "good")
    # rows of the years before have served for growth; their own may lack a year before
    ind = staged(indicators.long_form(indicators.derive(f["good"]), config.indicator_names()).join(with_peers, KEY, "left_semi"), "indicators")
    f["outliers"] = staged(deviation.outliers(deviation.deviations(ind.join(reach, KEY, "left_semi"), peers.peer_values(ind, f["peers"]))), "outliers")
    f["good"] = f["good"].join(reach, KEY, "left_semi")
    f["anomalies"] = staged(logic_checks.anomalies(f["good"], f["parent"]), "anomalies")
    for name in ("evidence", "context", "reasoning"):
        # by rule, causes are read more than once, and the context not at all
        f |= {k: staged(v, k) if how.provider or name == "reasoning" else v for k, v in stages.STAGES[name](f, how).items()}
    f |= stages.STAGES["scores"](f, how)
    f["blocked"] = f["blocked"].join(reach, KEY, "left_semi")
    out = {"rescored": reach}
    for name in ("scores", "outliers", "anomalies", "attribution", "blocked"):
        out[name] = old[name].join(reach, KEY, "left_anti").unionByName(f[name].select(*old[name].columns))
    return out
