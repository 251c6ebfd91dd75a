"""Text formats: typed tables, key/value documents, key lists, responses.

Documents are read by Spark's own readers, so any store that Spark reads will do; parsing is Column
expressions over lines. ``typed`` is also a registered data source, for schemas taken from the header.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.functions import keys as K

_KIND = {"STRING": T.StringType(), "HEX": T.BinaryType(), "DEC": T.LongType()}
_FIELD = re.compile(r"^([^!|]+)!([A-Za-z]+):(\d+)$")


class FormatError(ValueError):
    """A header or document outside its format."""


def parse_header(line: str) -> list[tuple[str, str]]:
    """SRC-02, 03: names and types of ``Name!TYPE:n|...``; the length is a hint only."""
    out = []
    for part in line.strip().split("|"):
        m = _FIELD.match(part)
        if not m or m[2].upper() not in _KIND:
            raise FormatError(f"not a field: {part!r}")
        out.append((m[1], m[2].upper()))
    return out


def header_schema(fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, _KIND[t]) for n, t in fields])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole files, numbered within their file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    return whole.select("doc", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01, 04, 38: the rows of typed tables with ``seqn`` and the row's place ``pos``.

    Blank lines and ``#`` lines are skipped, ``## seqn = n`` gives the sequence number, a row with another
    number of fields or a malformed value stops the query. All files have the first one's header.
    """
    lines = _lines(spark, path)
    plain = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    head = plain.groupBy("doc").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("head"))
    first = head.orderBy("doc").first()
    if first is None:
        raise FormatError("no header")
    fields = parse_header(first["line"])
    seq = lines.groupBy("doc").agg(F.max(F.regexp_extract("line", r"^\s*##\s*seqn\s*=\s*(\d+)", 1).try_cast("int")).alias("seqn"))
    body = plain.join(head.select("doc", "head"), "doc").where("pos > head").join(seq, "doc")
    return _typed_rows(body, fields).select(*[n for n, _ in fields], "seqn", "pos")


def _typed_rows(lines: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    parts = F.split("line", r"\|", -1)
    checked = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("line"))))
    return lines.withColumn("__f", checked).select("*", *[K.typed_value_strict(F.trim(F.col("__f")[i]), t).alias(n) for i, (n, t) in enumerate(fields)])


def typed_lines(df: DataFrame, fields: list[tuple[str, str]], order: list[str], seqn: int | None = None) -> DataFrame:
    """SNK-01, 02: one text column: the header, the sequence number, then the rows; ``line_no`` to sort by."""
    text = {"STRING": lambda c: c.cast("string"), "HEX": lambda c: F.lower(F.hex(c)), "DEC": lambda c: c.cast("string")}
    row = F.concat_ws("|", *[F.coalesce(text[t](F.col(n)), F.lit("")) for n, t in fields])
    w = Window.orderBy(*order)  # a response table: a few rows for each region or server
    head = ["|".join(f"{n}!{t}:{16 if t == 'HEX' else 4 if t == 'DEC' else 0}" for n, t in fields)]
    if seqn is not None:
        head.append(f"## seqn = {seqn}")
    top = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "line_no long, line string")
    return top.unionByName(df.select((F.row_number().over(w) + len(head) - 1).cast("long").alias("line_no"), row.alias("line")))


class TypedSource(DataSource):
    """EXT-01: ``spark.read.format("typedtable").load(path)`` for local files, schema from the header."""

    @classmethod
    def name(cls) -> str:
        return "typedtable"

    def schema(self) -> T.StructType:
        with open(self.options["path"], encoding="utf-8") as f:
            for line in f:
                if line.strip() and not line.lstrip().startswith("#"):
                    return header_schema(parse_header(line))
        raise FormatError("no header")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TypedReader(self.options["path"], schema)


class _TypedReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.kinds = path, [f.dataType for f in schema.fields]

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        header = True
        with open(self.path, encoding="utf-8") as f:
            for line in f:
                line = line.rstrip("\r\n")
                if not line.strip() or line.lstrip().startswith("#"):
                    continue
                if header:
                    header = False
                    continue
                parts = [p.strip() for p in line.split("|")]
                if len(parts) != len(self.kinds):
                    raise FormatError(f"wrong number of fields: {line}")
                yield tuple(None if p == "" else bytes.fromhex(p) if isinstance(k, T.BinaryType) else int(p) if isinstance(k, T.LongType) else p for p, k in zip(parts, self.kinds, strict=True))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05, 06: (doc, key, pos, value) of ``key = v1 v2`` documents; the last of repeated keys counts."""
    lines = _lines(spark, path).where(~F.trim("line").startswith("#") & F.col("line").contains("="))
    kv = lines.select("doc", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("v"), F.col("pos").alias("line_no"))
    last = kv.groupBy("doc", "key").agg(F.max_by("v", "line_no").alias("v"))
    return last.select("doc", "key", F.posexplode(F.filter(F.split("v", r"\s+"), lambda x: x != "")).alias("pos", "value"))


def key_value_lines(kv: DataFrame) -> DataFrame:
    """SNK-03, 04, 33, 34: ``key = v1 v2`` lines, one for each key."""
    vals = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return kv.groupBy("doc", "key").agg(F.concat(F.first("key"), F.lit(" = "), F.array_join(vals, " ")).alias("line"))


def archives(kv: DataFrame, names: str = "archives", sizes: str = "archives-index-size") -> DataFrame:
    """SRC-07, 08, 59: names zipped with sizes. Unparsable sizes are dropped first; a missing one is null."""
    a = kv.where(F.col("key") == names).select("doc", F.col("pos").alias("i"), F.col("value").alias("name"))
    s = kv.where((F.col("key") == sizes) & F.col("value").rlike(r"^\d+$")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"].cast("long")).alias("s"))
    return a.join(s, "doc", "left").select("doc", "i", "name", F.try_element_at("s", F.col("i") + 1).alias("size"))


def key_pairs(kv: DataFrame, name: str) -> DataFrame:
    """SRC-60: content and encoding key of an entry with their sizes; a missing second one is null."""
    wide = kv.where(F.col("key").isin(name, f"{name}-size")).groupBy("doc")
    pick = lambda k, p: F.max(F.when((F.col("key") == k) & (F.col("pos") == p), F.col("value")))
    return wide.agg(pick(name, 0).alias("ckey"), pick(name, 1).alias("ekey"), pick(f"{name}-size", 0).cast("long").alias("size"), pick(f"{name}-size", 1).cast("long").alias("encoded_size"))


def numbered_entries(kv: DataFrame, prefix: str = "vfs-") -> DataFrame:
    """SRC-12: entries 1, 2, ... up to the first gap."""
    n = F.regexp_extract("key", rf"^{re.escape(prefix)}(\d+)$", 1).try_cast("int")
    e = kv.withColumn("n", n).where("n > 0")
    steps = e.select("doc", "n").distinct().withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("n"))).where("n = k").select("doc", "n")
    return e.join(steps, ["doc", "n"])


def partial_priorities(kv: DataFrame, key: str = "build-partial-priority") -> DataFrame:
    """SRC-13: ``KEY:PRIORITY`` pairs; malformed ones are skipped."""
    v = F.explode(F.split("value", ","))
    p = kv.where(F.col("key") == key).select("doc", v.alias("v"))
    return p.select("doc", F.substring_index("v", ":", 1).alias("entry"), F.substring_index("v", ":", -1).try_cast("int").alias("priority")).where("priority is not null and entry <> ''")


def read_keyring(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09, VAL-07: (key_id, key_value, pos) of ``key-ID = VALUE`` lines."""
    rx = r"^\s*key-([0-9A-Fa-f]{16})\s*=\s*([0-9A-Fa-f]{32})\s*$"
    return _lines(spark, path).where(F.col("line").rlike(rx)).select(F.lower(F.regexp_extract("line", rx, 1)).alias("key_id"), F.lower(F.regexp_extract("line", rx, 2)).alias("key_value"), "pos")


def keyring_lines(keys: DataFrame) -> DataFrame:
    """SNK-33."""
    return keys.select("pos", F.format_string("key-%s = %s", F.lower("key_id"), F.lower("key_value")).alias("line"))


def read_patch_entries(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10, FLT-32: (doc, pos, type, keys, sizes) of ``patch-entry = type key size ...`` lines."""
    rx = r"^\s*patch-entry\s*=\s*(\S+)\s+(.*)$"
    lines = _lines(spark, path).where(F.col("line").rlike(rx))
    rest = F.filter(F.split(F.regexp_extract("line", rx, 2), r"\s+"), lambda x: x != "")
    return lines.select("doc", "pos", F.regexp_extract("line", rx, 1).alias("type"), F.filter(rest, lambda x: x.rlike("^[0-9a-fA-F]{32}$")).alias("keys"), F.transform(F.filter(rest, lambda x: x.rlike(r"^\d{1,18}$")), lambda x: x.cast("long")).alias("sizes"))


def read_key_list(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """SRC-47, 48: (key_id, key_value) of ``id,key`` or, with a space, ``id key`` lines; bad lines are skipped."""
    parts = F.split(F.trim("line"), re.escape(separator) if separator != " " else r"\s+")
    rows = _lines(spark, path).where(~F.trim("line").startswith("#")).withColumn("f", parts)
    clean = lambda c: F.lower(F.regexp_replace(F.trim(c), "^0[xX]", ""))
    ok = (F.size("f") == 2) if separator != " " else (F.size("f") >= 2)
    out = rows.where(ok).select(clean(F.col("f")[0]).alias("key_id"), clean(F.col("f")[1]).alias("key_value"), "pos")
    return out.where(F.col("key_id").rlike("^[0-9a-f]{1,16}$") & F.col("key_value").rlike("^[0-9a-f]{32}$")).withColumn("key_id", F.lpad("key_id", 16, "0"))


BUILDS = "id long, product string, version string, build string, build_config string, cdn_config string, keyring string, product_config string, build_time string, encoding_ekey string, root_ekey string, install_ekey string, download_ekey string, cdn_path string"


def build_valid(c: str = "") -> Column:
    """FLT-41: non-empty names, keys of 32 hex digits, a time like ISO 8601."""
    key = lambda n: F.coalesce(F.col(n).rlike("^[0-9a-fA-F]{32}$"), F.lit(False))
    full = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    ok = full("product") & full("version") & full("build") & F.coalesce(F.col("build_time").contains("T") & F.col("build_time").contains(":"), F.lit(False))
    for n in ("build_config", "cdn_config", "encoding_ekey", "root_ekey", "install_ekey", "download_ekey"):
        ok = ok & key(n)
    for n in ("keyring", "product_config"):
        ok = ok & (F.col(n).isNull() | key(n))
    return ok


#: Fixed value: what stands between documents of a file that holds many (a JSON text has it only escaped).
RECORD_SEPARATOR = "\x1e"


def _documents(spark: SparkSession, path: str, many: bool) -> DataFrame:
    """Whole files, or the documents of files that hold many, in ``value``."""
    r = spark.read.option("recursiveFileLookup", "true")
    return r.text(path, lineSep=RECORD_SEPARATOR) if many else r.text(path, wholetext=True)


def read_builds(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """SRC-46: build records of JSON arrays with their place; one bad record stops the query."""
    raw = _documents(spark, path, many).select(F.posexplode(F.from_json("value", f"array<struct<{BUILDS.replace(' ', ':').replace(',:', ', ')}>>")).alias("pos", "b")).select("b.*", "pos")
    return raw.where(F.when(build_valid(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a bad build record at "), F.col("pos").cast("string")))))


def product_config_json(product: Column) -> Column:
    """SNK-35: a product's configuration as indented JSON, from a struct of its ``uid`` and ``dir``."""
    doc = F.struct(F.struct(F.struct(product["uid"].alias("product"), F.struct(F.struct(product["dir"].alias("dirname")).alias("game_dir")).alias("form")).alias("config")).alias("all"))
    return F.to_json(doc, {"pretty": "true"})


def read_product_configs(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """SRC-11: (doc, product_uid, document) of JSON documents, one a file or with separators; one that is no JSON object stops the query."""
    raw = _documents(spark, path, many).select(F.input_file_name().alias("doc"), F.col("value").alias("document"))
    whole = F.from_json("document", "map<string,string>").isNotNull() & F.get_json_object("document", "$.all.config").isNotNull()
    checked = raw.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a bad product configuration: "), F.col("doc")))))
    return checked.select("doc", F.get_json_object("document", "$.all.config.product").alias("product_uid"), "document")


REGIONS = ["us", "eu", "cn", "kr", "tw", "sg", "xx"]
VERSIONS = [("Region", "STRING"), ("BuildConfig", "HEX"), ("CDNConfig", "HEX"), ("KeyRing", "HEX"), ("BuildId", "DEC"), ("VersionsName", "STRING"), ("ProductConfig", "HEX")]


def versions_table(builds: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """SNK-23, 25: one row for each build and region."""
    r = F.explode(F.array(*[F.lit(x) for x in regions or REGIONS])).alias("Region")
    return builds.select(r, "product", F.unhex("build_config").alias("BuildConfig"), F.unhex("cdn_config").alias("CDNConfig"), F.unhex("keyring").alias("KeyRing"), F.col("build").try_cast("long").alias("BuildId"), F.col("version").alias("VersionsName"), F.unhex("product_config").alias("ProductConfig"))


def cdns_table(builds: DataFrame, path: str, hosts: list[str], config_path: str, regions: list[str] | None = None) -> DataFrame:
    """SNK-24, PRJ-25: delivery rows; a build's own path replaces both paths."""
    r = F.explode(F.array(*[F.lit(x) for x in regions or REGIONS[:5]])).alias("Name")
    own = F.col("cdn_path")
    return builds.select("product", r, F.coalesce(own, F.lit(path)).alias("Path"), F.lit(" ".join(hosts)).alias("Hosts"), F.lit(" ".join(f"https://{h}/?maxhosts=4" for h in hosts)).alias("Servers"), F.coalesce(own, F.lit(config_path)).alias("ConfigPath"))


def summary_table(builds: DataFrame, seqn: int) -> DataFrame:
    """SNK-26."""
    return builds.select(F.col("product").alias("Product"), F.lit(seqn).cast("long").alias("Seqn")).distinct().orderBy("Product")


def mime_wrap(body: Column, boundary: str = "strandline") -> Column:
    """SNK-27: a multipart message with the SHA-256 of all before it as epilogue."""
    text = F.concat(F.lit(f'Content-Type: multipart/alternative; boundary="{boundary}"\r\n\r\n--{boundary}\r\nContent-Type: text/plain\r\n\r\n'), body, F.lit(f"\r\n--{boundary}--\r\n"))
    return F.concat(text, F.lit("Checksum: "), F.sha2(text, 256), F.lit("\r\n"))


def mime_parts(message: Column) -> Column:
    """SRC-49, 66: struct of the message's text part and whether its checksum holds."""
    rx = r"(?s)^(.*\r\n)Checksum: ([0-9a-fA-F]{64})\r\n$"
    b = F.regexp_extract(message, r'boundary="([^"]+)"', 1)
    part = F.regexp_extract(message, r"(?s)\r\n\r\n--[^\r\n]+\r\n.*?\r\n\r\n(.*)\r\n--[^\r\n]+--\r\n", 1)
    return F.struct(b.alias("boundary"), part.alias("body"), (F.sha2(F.regexp_extract(message, rx, 1), 256) == F.lower(F.regexp_extract(message, rx, 2))).alias("valid"))


def server_table(cdns: DataFrame, product: str | None = None) -> DataFrame:
    """SRC-50: hosts of the rows whose name contains the product, with priority 10, 20, ... in their order."""
    rows = cdns if product is None else cdns.where(F.col("Name").contains(product))
    hosts = rows.select(F.posexplode(F.filter(F.split("Hosts", " "), lambda h: h != "")).alias("i", "host"), F.col("Path").alias("path"))
    return hosts.select("host", "path", ((F.col("i") + 1) * 10).alias("priority"))


def fallback_servers(spark: SparkSession, hosts: list[str], path: str) -> DataFrame:
    """SRC-67: a fixed list, in order."""
    return spark.createDataFrame([(h, path, 10 * (i + 1)) for i, h in enumerate(hosts)], "host string, path string, priority int")


def required_keys(kv: DataFrame, names: list[str]) -> DataFrame:
    """VAL-05, 06, 08, 09: documents with the names that they lack."""
    have = kv.groupBy("doc").agg(F.collect_set("key").alias("have"))
    return have.select("doc", F.array_except(F.array(*[F.lit(n) for n in names]), "have").alias("missing")).where(F.size("missing") > 0)
