"""Readers of text formats as DataFrames: gene sets, ontologies, annotations, features, sequences, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gmt(lines: DataFrame) -> DataFrame:
    """(set_name, member) from lines `name<TAB>description<TAB>member...`; a `,weight` suffix is cut, short lines are skipped.

    lines: a DataFrame with a column value, as spark.read.text gives (plain or gzip).
    """
    parts = F.split("value", "\t")
    members = F.filter(F.transform(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda x: F.trim(F.split(x, ",")[0])), lambda x: x != "")
    return lines.where(F.size(parts) >= 3).select(parts[0].alias("set_name"), F.explode(members).alias("member")).distinct()


def obo(stanzas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (id, parent), aliases (alt_id, id)) from [Term] stanzas in a column value; obsolete terms are dropped.

    Read with spark.read.text(path, lineSep="[Term]").
    """
    body = F.split("value", r"\n\[")[0]
    first = lambda p: F.regexp_extract(body, p, 1)
    terms = stanzas.where(body.rlike(r"(?m)^id: ") & ~body.rlike(r"(?m)^is_obsolete: true")).select(
        first(r"(?m)^id: (\S+)").alias("id"),
        F.concat(F.regexp_extract_all(body, F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"(?m)^relationship: part_of (\S+)"), F.lit(1))).alias("parents"),
        F.regexp_extract_all(body, F.lit(r"(?m)^alt_id: (\S+)"), F.lit(1)).alias("alts"),
    )
    return terms.select("id", F.explode("parents").alias("parent")).distinct(), terms.select(F.explode("alts").alias("alt_id"), "id")


def gaf(lines: DataFrame, evidence: list[str]) -> DataFrame:
    """(symbol, term, code) of annotation lines with an allowed evidence code and without the NOT qualifier."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("!") & (F.size(c) >= 7)).select(c[2].alias("symbol"), c[3].alias("qualifier"), c[4].alias("term"), c[6].alias("code"))
    return rows.where(F.col("code").isin(evidence) & ~F.array_contains(F.split("qualifier", r"\|"), "NOT")).select("symbol", "term", "code").distinct()


def gtf(lines: DataFrame) -> DataFrame:
    """(chrom, kind, start, end, strand, attributes map) of feature lines."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(c) >= 9))
    keys = F.regexp_extract_all(c[8], F.lit(r'(\S+) "([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(c[8], F.lit(r'(\S+) "([^"]*)"'), F.lit(2))
    pairs = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.get(values, F.array_position(keys, k).cast("int") - 1).alias("v")))
    return rows.select(c[0].alias("chrom"), c[2].alias("kind"), c[3].cast("long").alias("start"), c[4].cast("long").alias("end"), c[6].alias("strand"), F.map_from_entries(pairs).alias("attributes"))


def sequence_chunks(sequences: DataFrame, width: int = 1000) -> DataFrame:
    """(chrom, chunk, seq): sequences (chrom, seq) cut into chunks of one width for random access."""
    n = F.ceil(F.length("seq") / width).cast("int")
    return sequences.where(F.length("seq") > 0).select("chrom", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"), "seq").select("chrom", "chunk", F.upper(F.substring("seq", F.col("chunk") * width + 1, F.lit(width))).alias("seq"))


def fetch(chunks: DataFrame, ranges: DataFrame, width: int = 1000) -> DataFrame:
    """(id, seq) of ranges (id, chrom, start, end), 1-based and inclusive, clipped to the sequence."""
    wanted = ranges.select("id", "chrom", F.greatest("start", F.lit(1)).alias("s"), "end")
    wanted = wanted.select("*", F.explode(F.sequence(F.floor((F.col("s") - 1) / width).cast("int"), F.floor((F.greatest("end", "s") - 1) / width).cast("int"))).alias("chunk"))
    met = wanted.join(chunks, ["chrom", "chunk"])
    begin = F.greatest(F.col("s") - F.col("chunk") * width, F.lit(1))
    stop = F.least(F.col("end") - F.col("chunk") * width, F.lit(width))
    part = F.when(stop >= begin, F.substring("seq", begin.cast("int"), (stop - begin + 1).cast("int"))).otherwise("")
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def delimited(spark: SparkSession, path: str, required: list[str], sep: str = "\t") -> DataFrame:
    """A delimited file with a header (plain, gzip or bzip2), all strings; a missing required column fails at once."""
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*required)


def first_column(df: DataFrame, names: list[str]) -> str:
    """The first of names that df has: how a label column is found."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} in {df.columns}")


def symbol_column(df: DataFrame, index: str, symbol: str) -> Column:
    """index, unless over half of its values look like accession ids and a symbol column exists."""
    share = df.agg(F.avg(F.col(index).rlike("^ENS[A-Z]*\\d{6,}").cast("int")).alias("s")).head().s or 0
    return F.col(symbol) if share > 0.5 and symbol in df.columns else F.col(index)


def zip_members(binary: DataFrame) -> DataFrame:
    """(path, value): text of the first member of zip files read with the binaryFile source."""
    import io
    import zipfile

    import pandas as pd

    def read(batches):
        for b in batches:
            texts = []
            for c in b["content"]:
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    texts.append(z.read(z.namelist()[0]).decode("utf-8"))
            yield pd.DataFrame({"path": b["path"], "value": texts})

    return binary.select("path", "content").mapInPandas(read, "path string, value string")
