"""A user's own settings: a folder of YAML (or JSON) files in place of the built-in
vocabulary, weights, thresholds, tags and prompts."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from finsift.sources import config, prompts

try:
    import yaml
except ImportError:  # JSON is read without it
    yaml = None


def _read(spark: SparkSession, folder: str) -> dict[str, object]:
    """Settings files of a folder that Spark can read, by name without ending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for s in files.listStatus(path):
        name = PurePosixPath(s.getPath().getName())
        if s.isDirectory() or name.suffix not in (".yaml", ".yml", ".json"):
            continue
        if name.suffix != ".json" and yaml is None:
            raise ImportError(f"{name}: reading YAML needs PyYAML; JSON of the same form is read too")
        text = spark.read.text(s.getPath().toString(), wholetext=True).first()["value"]
        out[name.stem] = json.loads(text) if name.suffix == ".json" else yaml.safe_load(text)
    return out


def use(spark: SparkSession, folder: str) -> None:
    """Take what a folder has of financial_fields, weights, thresholds, industry_tags
    and prompts/*; what it lacks stays built in.  Settings hold for this program.

    An indicator that isn't built in says what it is made of: ``ratio: [above, below]`` or
    ``growth: field``, by standard names; a field that isn't built in is one of
    financial_fields.  Every stage reads both when it runs."""
    found = _read(spark, folder)
    if "financial_fields" in found:
        config.FIELDS = tuple((name, f["type"], tuple(f["chinese_variants"])) for name, f in found["financial_fields"]["fields"].items())
    if "weights" in found:
        config.INDICATORS = tuple((name, w["category"], float(w["base_weight"]), w["direction"], float(w["amplification_cap"])) for name, w in found["weights"]["weights"].items())
        for name, w in found["weights"]["weights"].items():
            if "ratio" in w:
                config.RATIOS = config.RATIOS | {name: tuple(w["ratio"])}
            if "growth" in w:
                config.GROWTHS = config.GROWTHS | {name: w["growth"]}
        formed = config.RATIOS.keys() | config.GROWTHS.keys()
        if bare := [n for n in config.indicator_names() if n not in formed]:
            raise ValueError(f"weights: {bare} need a ratio (two fields) or a growth (one)")
    if "thresholds" in found:
        b, c = found["thresholds"].get("bplus", {}), found["thresholds"].get("c_layer", {})
        for name, key in (("CASH_TO_PROFIT", "净现比"), ("CASH_TO_REVENUE", "收现比")):
            if key in b:
                setattr(config, name, (*map(float, b[key]["normal_range"]), float(b[key]["severe_threshold"])))
        if "净现比" in b:
            config.CASH_NORMAL = float(b["净现比"]["normal_range"][0])
        config.BOTH_HIGH = float(b.get("存贷双高", {}).get("both_above", config.BOTH_HIGH))
        gap = b.get("母子资金分离度", {})
        config.GAP_SEVERE, config.GAP_WARNING = float(gap.get("severe_ratio", config.GAP_SEVERE)), float(gap.get("warning_ratio", config.GAP_WARNING))
        config.ABNORMAL, config.EXTREME = float(c.get("mad_threshold", config.ABNORMAL)), float(c.get("extreme_threshold", config.EXTREME))
    if "industry_tags" in found:
        soft = found["industry_tags"].get("soft_tags", {})
        pairs = soft.items() if isinstance(soft, dict) else ((t["name"], t) for t in soft)
        config.SOFT_TAGS = tuple((d, tuple(t["options"] if isinstance(t, dict) else t)) for d, t in pairs)
    sub = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/prompts")
    if sub.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(sub):
        for name, p in _read(spark, f"{folder}/prompts").items():
            prompts.TEMPLATES[p.get("name", name)] = "\n\n".join(m["content"].strip() for m in p["messages"])


def fingerprint() -> str:
    """A digest of all settings that results depend on."""
    held = {n: getattr(config, n) for n in sorted(vars(config)) if n.isupper()}
    return hashlib.sha256(json.dumps([held, prompts.TEMPLATES], ensure_ascii=False, sort_keys=True, default=list).encode()).hexdigest()
