"""Connectors: rows of known data sets (all text, as read) to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scalars import lookup, safe_double, safe_long
from ..registry import connectors
from .readers import read_csv


def _renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    seen: set[str] = set()
    cols = []
    for c in df.columns:
        name = aliases.get(c.lower().strip().lstrip("﻿"))
        if name and name not in seen:
            seen.add(name)
            cols.append(F.col(f"`{c}`").cast("string").alias(name))
    return df.select(*cols, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw"), *(["record_index"] if "record_index" in df.columns else []))


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _record(df: DataFrame, source: str, cols: dict[str, Column]) -> DataFrame:
    index = F.col("record_index") if "record_index" in df.columns else F.monotonically_increasing_id()
    return df.select(F.format_string(f"{source}-%08d", index).alias("record_id"), F.lit(source).alias("source"), index.alias("record_index"), *[v.alias(k) for k, v in cols.items()], "raw")


@connectors.register("cicids_2017")
def cicids(df: DataFrame, source: str = "cicids_2017") -> DataFrame:
    """NaN and infinite cells count as missing; protocol numbers become names."""
    d = _renamed(df, vocab.CICIDS_COLUMNS)
    clean = lambda n: F.when(~F.lower(F.trim(_col(d, n))).isin("nan", "inf", "infinity", "-infinity", "+infinity", ""), F.trim(_col(d, n)))
    proto = F.coalesce(lookup(clean("protocol"), vocab.PROTOCOL_NUMBERS), F.lower(clean("protocol")))
    cols = {n: clean(n) for n in ("src_ip", "dst_ip", "timestamp")} | {n: safe_long(clean(n)) for n in ("src_port", "dst_port", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv")}
    return _record(d, source, cols | {"protocol": proto, "duration": safe_double(clean("duration")), "source_label": clean("label")})


@connectors.register("cicids_2018")
def cicids_2018(df: DataFrame) -> DataFrame:
    return cicids(df, "cicids_2018")


@connectors.register("ctu_13")
def ctu(df: DataFrame) -> DataFrame:
    """Hexadecimal ports, received bytes as the rest of the total, botnet before normal before background in labels."""
    d = _renamed(df, vocab.CTU_COLUMNS)
    port = lambda n: F.when(F.lower(_col(d, n)).startswith("0x"), F.conv(F.substring(_col(d, n), 3, 16), 16, 10).try_cast("bigint")).otherwise(safe_long(_col(d, n)))
    sent, total, low = safe_long(_col(d, "bytes_sent")), safe_long(_col(d, "total_bytes")), F.lower(_col(d, "label"))
    label = F.when(low.contains("botnet"), "Botnet").when(low.contains("normal"), "Normal").when(low.contains("background"), "Background").otherwise(_col(d, "label"))
    recv = F.when(total.isNotNull(), F.greatest(total - F.coalesce(sent, F.lit(0)), F.lit(0)))
    cols = {n: _col(d, n) for n in ("timestamp", "src_ip", "dst_ip")} | {"src_port": port("src_port"), "dst_port": port("dst_port"), "protocol": F.lower(_col(d, "protocol"))}
    return _record(d, "ctu_13", cols | {"duration": safe_double(_col(d, "duration")), "bytes_sent": sent, "bytes_recv": recv, "packets_sent": safe_long(_col(d, "total_packets")), "source_label": label})


@connectors.register("unsw_nb15")
def unsw(df: DataFrame) -> DataFrame:
    """The binary label decides: 0 (or none) is Normal; else the attack category, else Attack. Features go to the tags."""
    d = _renamed(df, vocab.UNSW_COLUMNS | {c: c for c in vocab.UNSW_FEATURES})
    flag, cat = F.coalesce(F.trim(_col(d, "label")), F.lit("0")), F.nullif(F.trim(_col(d, "attack_cat")), F.lit(""))
    label = F.when(flag == "0", "Normal").otherwise(F.coalesce(cat, F.lit("Attack")))
    extra = [x for c in vocab.UNSW_FEATURES if c in d.columns for x in (F.lit(c), F.col(c))]
    tags = F.map_filter(F.create_map(*extra), lambda _, v: v.isNotNull()) if extra else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    cols = {n: _col(d, n) for n in ("timestamp", "src_ip", "dst_ip")} | {n: safe_long(_col(d, n)) for n in ("src_port", "dst_port", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv")}
    return _record(d, "unsw_nb15", cols | {"protocol": F.lower(_col(d, "protocol")), "duration": safe_double(_col(d, "duration")), "source_label": label, "enrichment_tags": tags})


@connectors.register("ember")
def ember(df: DataFrame) -> DataFrame:
    """Rows with raw JSON text: label 0 benign, 1 malware, else unknown; file hash and PE facts."""
    get = lambda p: F.get_json_object("raw", p)
    good = df.filter(F.try_parse_json("raw").isNotNull())
    label = F.coalesce(get("$.label"), F.lit("-1"))
    name = F.when(label == "0", "benign").when(label == "1", "malware").otherwise("unknown")
    facts = F.create_map(*[x for k, p in (("pe_size", "$.general.size"), ("pe_has_debug", "$.general.has_debug"), ("pe_machine", "$.header.coff.machine")) for x in (F.lit(k), get(p))])
    features = F.array_except(F.json_object_keys("raw"), F.array(F.lit("sha256"), F.lit("label")))
    tags = F.map_filter(F.map_concat(facts, F.create_map(F.lit("features"), F.array_join(features, ","))), lambda _, v: v.isNotNull())
    return _record(good, "ember", {"file_hash": F.lower(get("$.sha256")), "file_path": get("$.general.filename"), "source_label": name, "enrichment_tags": tags})


@connectors.register("mitre_attack")
def stix(df: DataFrame) -> DataFrame:
    """Technique records of STIX bundles or plain technique lists (rows with raw JSON text)."""
    objects = F.explode(F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.objects", "array<variant>"), F.try_variant_get(F.try_parse_json("raw"), "$.techniques", "array<variant>"), F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>"))).alias("o")
    rows = df.select(objects)
    s = lambda p: F.try_variant_get("o", p, "string")
    rows = rows.filter((s("$.type") == "attack-pattern") | s("$.technique_id").isNotNull())
    refs = F.from_json(F.to_json(F.try_variant_get("o", "$.external_references", "array<variant>")), "array<struct<source_name:string,external_id:string>>")
    ref = F.try_element_at(F.filter(refs, lambda r: r["source_name"] == "mitre-attack"), F.lit(1))["external_id"]
    phases = F.from_json(F.to_json(F.try_variant_get("o", "$.kill_chain_phases", "array<variant>")), "array<struct<kill_chain_name:string,phase_name:string>>")
    tactic = F.array_join(F.transform(F.filter(phases, lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"]), ", ")
    rows = rows.withColumn("raw", F.to_json("o"))
    return _record(rows, "mitre_attack", {"mitre_technique_id": F.coalesce(ref, s("$.technique_id")), "mitre_technique_name": F.coalesce(s("$.name"), s("$.technique_name")), "mitre_tactic": F.coalesce(F.nullif(tactic, F.lit("")), s("$.tactic")), "source_label": F.lit("malicious")})


@connectors.register("custom_csv")
def custom(df: DataFrame, mapping: dict[str, str] | None = None, source: str = "custom_csv") -> DataFrame:
    """An explicit mapping (column -> field) first, then columns whose name is a field's (blanks and dashes as underscores)."""
    fields = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "hostname", "username", "process_name", "command_line", "file_path", "file_hash", "source_label"]
    names = {c.lower().strip(): f for c, f in (mapping or {}).items()}
    names = {c.lower().strip(): f for c in df.columns if (f := c.lower().strip().replace(" ", "_").replace("-", "_")) in fields} | names
    if "label" in [c.lower() for c in df.columns] and "source_label" not in names.values():
        names["label"] = "source_label"
    d = _renamed(df, names)
    number = ("src_port", "dst_port", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv")
    return _record(d, source, {f: safe_long(_col(d, f)) if f in number else safe_double(_col(d, f)) if f == "duration" else _col(d, f) for f in fields})


def read_custom(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, sep: str = ",", encoding: str = "UTF-8", source: str = "custom_csv") -> DataFrame:
    """Records of a CSV file, or of the CSV files of a folder, with a header row; rows are numbered in each file."""
    rows = read_csv(spark, path, sep, encoding)
    names = sorted({k for r in rows.select(F.explode(F.json_object_keys("raw")).alias("k")).distinct().collect() for k in [r["k"]]})  # the columns
    cells = rows.select("record_index", *[F.get_json_object("raw", f"$['{c}']").alias(c) for c in names])
    return custom(cells, mapping, source)


@connectors.register("labelled_frame")
def labelled(df: DataFrame, mapping: dict[str, str] | None = None, source: str = "custom") -> DataFrame:
    """Any frame; its label is the first there is of label, Label, labels, target, class, category."""
    label = next((c for c in ("label", "Label", "labels", "target", "class", "category") if c in df.columns), None)
    return custom(df, (mapping or {}) | ({label: "source_label"} if label else {}), source)


@connectors.register("soc")
def soc(df: DataFrame) -> DataFrame:
    """Nested triage records (raw JSON text; input and output may be JSON text themselves) to records."""
    g = lambda c, p: F.get_json_object(c, p)
    d = df.withColumns({"_in": g("raw", "$.input"), "_out": g("raw", "$.output")})
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    alert = lambda k: first(g("_in", f"$.alert.{k}"), g("raw", f"$.alert.{k}"), g("raw", f"$.{k}"))
    ctx = lambda *ks: first(*[g("_in", f"$.context.{k}") for k in ks], *[g("_in", f"$.alert.{k}") for k in ks], *[g("raw", f"$.{k}") for k in ks])
    cls, sev = F.lower(F.trim(g("_out", "$.classification"))), F.lower(F.trim(g("_out", "$.severity")))
    tags = F.map_filter(F.create_map(F.lit("soc_task"), g("raw", "$.task"), F.lit("soc_metadata"), g("raw", "$.metadata"), F.lit("adapter"), F.lit("soc"), F.lit("adapter_version"), F.lit("1.0")), lambda _, v: v.isNotNull())
    classes = [c for c in vocab.CLASSIFICATIONS if c != "review_required"]
    cols = {
        "timestamp": alert("timestamp"), "src_ip": first(alert("source_ip"), alert("src_ip"), ctx("source_ip", "src_ip", "ip_address")),
        "dst_ip": first(alert("destination_ip"), alert("dst_ip"), ctx("destination_ip", "dest_ip", "dst_ip")),
        "src_port": safe_long(first(alert("source_port"), alert("src_port"))), "dst_port": safe_long(first(alert("destination_port"), alert("dst_port"))), "protocol": alert("protocol"),
        "hostname": ctx("hostname"), "username": ctx("username"), "process_name": ctx("process_name"), "command_line": ctx("command_line"), "file_hash": ctx("file_hash"),
        "source_label": cls, "classification": F.when(cls.isin(classes), cls), "severity": F.when(sev.isin(vocab.SEVERITIES), sev),
        "confidence": F.coalesce(safe_double(g("_out", "$.confidence")), F.lit(1.0)), "enrichment_tags": tags,
    }
    return _record(d, "soc", cols).withColumn("record_id", F.coalesce(g("raw", "$.id"), "record_id"))
