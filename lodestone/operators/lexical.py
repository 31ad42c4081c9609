"""BM25 over an inverted index kept as tables."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.analysis import Analyzer
from lodestone.operators.vector import DIGITS
from lodestone.sources.store import Files, Versions

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, dl), and the size and mean length of the whole collection."""

    postings: DataFrame
    n_docs: int
    mean_length: float
    analyzer: Analyzer
    parts: int | None = None  # postings also hold part, a term's folder of so many


def counted(rows: DataFrame, analyzer: Analyzer, key: str = "id", text: str = "text") -> DataFrame:
    """id, t (the sorted tokens) and dl (how many)."""
    return rows.select(F.col(key).alias("id"), F.sort_array(analyzer.tokens(F.col(text))).alias("t")).withColumn("dl", F.size("t"))


def runs(counted: DataFrame) -> DataFrame:
    """(term, id, tf, dl). Terms are counted within their row, as runs of its sorted tokens, so nothing shuffles."""
    firsts = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    found = counted.where("dl > 0").withColumn("at", firsts)
    one = lambda i, n: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.col("dl")) - i).alias("tf"))
    return found.select("id", "dl", F.inline(F.transform("at", one))).select("term", "id", "tf", "dl")


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


class StoredIndex:
    """Postings kept as segments, each in folders by the terms' hash, so that a search reads its terms' folders alone.

    A refresh adds a segment for the rows that are new and notes the ids that are
    gone; both are found by ids alone. Once a quarter of what is indexed is gone, or
    MOST_SEGMENTS segments stand, it is made anew. Sizes are kept with the version, so a
    search counts nothing.
    """

    MOST_SEGMENTS = 16

    def __init__(self, spark: SparkSession, root: str, analyzer: Analyzer = Analyzer(), parts: int = 64, key: str = "id", text: str = "text"):
        self.spark, self.root, self.analyzer, self.parts, self.key, self.text = spark, root.rstrip("/"), analyzer, parts, key, text
        self.files = Files(spark, root)
        self.versions = Versions(self.files)

    def state(self) -> dict:
        """version, analyzer, parts, segments, gone (folders of ids), n_docs, length and n_gone; of an index in another way of analysis, nothing."""
        none = {"analyzer": asdict(self.analyzer), "parts": self.parts, "segments": [], "gone": [], "n_docs": 0, "length": 0, "n_gone": 0}
        found = self.versions.newest()
        return none | (found if found.get("analyzer", none["analyzer"]) == none["analyzer"] else {"version": found["version"]})

    def _docs(self, was: dict) -> DataFrame:
        return self._parquet([f"{s}/docs" for s in was["segments"]])

    def _parquet(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def _segment(self, rows: DataFrame, version: int) -> tuple[str, int, int]:
        """Writes a segment; its folder, how many rows have been indexed and their terms in all."""
        name = f"segments/{version:012d}-{uuid.uuid4().hex[:8]}"
        counted(rows, self.analyzer, self.key, self.text).write.parquet(f"{self.root}/{name}/terms")
        held = self._parquet([f"{name}/terms"])
        held.select("id", "dl").write.parquet(f"{self.root}/{name}/docs")
        post = runs(held).withColumn("part", part_of(F.col("term"), self.parts))
        post.repartition("part", F.pmod(F.hash("id"), F.lit(4))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.root}/{name}/postings")
        self.files.delete(f"{name}/terms")
        n = self._parquet([f"{name}/docs"]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, n[0], n[1]

    def rebuild(self, rows: DataFrame) -> int:
        was = self.state()
        name, n, length = self._segment(rows, was["version"] + 1)
        now = {"analyzer": asdict(self.analyzer), "parts": self.parts, "segments": [name], "gone": [], "n_docs": n, "length": length, "n_gone": 0}
        number = self.versions.add(was["version"], now)
        self._forget(number)
        return number

    def refresh(self, rows: DataFrame) -> int:
        """Brings the index up to date with ``rows``, whose ids name their texts; makes it where there is none."""
        was = self.state()
        if not was["segments"]:
            return self.rebuild(rows)
        known = self._docs(was)
        if was["gone"]:
            known = known.join(self._parquet(was["gone"]).select("id"), "id", "left_anti")
        ids = rows.select(F.col(self.key).alias("id"))
        gone = f"gone/{was['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        known.join(ids, "id", "left_anti").write.parquet(f"{self.root}/{gone}")
        lost = self._parquet([gone]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        new = rows.join(known.select(F.col("id").alias(self.key)), self.key, "left_anti")
        name, n, length = self._segment(new, was["version"] + 1)
        if not n and not lost[0]:
            self.files.delete(name)
            self.files.delete(gone)
            return was["version"]
        n_gone = was["n_gone"] + lost[0]
        if 4 * n_gone > was["n_docs"] + n or len(was["segments"]) >= self.MOST_SEGMENTS:
            return self.rebuild(rows)
        # An id that comes back stands in a newer segment than the one it is gone from.
        if was["gone"] and not self._parquet(was["gone"]).join(ids, "id", "left_semi").isEmpty():
            return self.rebuild(rows)
        now = was | {"segments": was["segments"] + ([name] if n else []), "gone": was["gone"] + ([gone] if lost[0] else []), "n_docs": was["n_docs"] + n - lost[0], "length": was["length"] + length - lost[1], "n_gone": n_gone}
        now.pop("version")
        number = self.versions.add(was["version"], now)
        self._forget(number)
        return number

    def _forget(self, newest: int) -> None:
        """Drops what the two newest versions do not name."""
        numbers = self.versions.numbers()
        kept = [x for n in numbers[-2:] if (x := self.versions.load(n))]
        named = {f for x in kept for f in (*x["segments"], *x["gone"])}
        for n in numbers[:-2]:
            self.files.delete(f"versions/{n:012d}.json")
        for folder in ("segments", "gone"):
            for name in self.files.names(folder):
                if f"{folder}/{name}" not in named and int(name.split("-")[0]) <= newest:
                    self.files.delete(f"{folder}/{name}")

    def index(self) -> Index | None:
        """The index as it stands; None where none has been made."""
        was = self.state()
        if not was["segments"]:
            return None
        kind = self._docs(was).schema["id"].dataType.simpleString()
        reader = self.spark.read.schema(f"term string, id {kind}, tf int, dl int, part int")
        folders = [f"{s}/postings" for s in was["segments"] if any(n.startswith("part=") for n in self.files.names(f"{s}/postings"))]
        post = self.spark.createDataFrame([], f"term string, id {kind}, tf int, dl int, part int")
        for i, f in enumerate(folders):
            one = reader.parquet(f"{self.root}/{f}")
            post = post.unionByName(one) if i else one
        if was["gone"]:
            post = post.join(self._parquet(was["gone"]).select("id"), "id", "left_anti")
        return Index(post, was["n_docs"], was["length"] / was["n_docs"] if was["n_docs"] else 0.0, self.analyzer, was["parts"])


def live(rows: DataFrame, query: str, analyzer: Analyzer = Analyzer(), key: str = "id", text: str = "text") -> Index:
    """An index of the query's terms alone, from one pass over the rows."""
    terms = query_terms(rows, query, analyzer)
    counted = rows.select(F.col(key).alias("id"), analyzer.tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    sizes = counted.agg(F.count(F.lit(1)), F.avg("dl")).first()
    hits = counted.select("id", "dl", F.explode(F.filter("t", lambda x: x.isin(*terms) if terms else F.lit(False))).alias("term"))
    return Index(hits.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")), sizes[0], float(sizes[1] or 0.0), analyzer)


def query_terms(rows: DataFrame, query: str, analyzer: Analyzer) -> list[str]:
    spark = rows.sparkSession
    return sorted(set(spark.createDataFrame([(query,)], "q string").select(analyzer.tokens(F.col("q"))).first()[0]))


def search(ix: Index, query: str, limit: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, fts_score): rows that hold any term of the query, best first.

    ``allowed`` (a column id) narrows the hits; the collection's statistics stay those of the whole.
    """
    terms = query_terms(ix.postings, query, ix.analyzer)
    hits = ix.postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    if ix.parts and terms:  # the folders to read are known before the scan
        of = ix.postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(part_of(F.col("t"), ix.parts)).distinct()
        hits = hits.where(F.col("part").isin([r[0] for r in of.collect()])).drop("part")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None:
        hits = hits.join(allowed, "id", "left_semi")
    # At most a row for each term of the query.
    hits = hits.join(F.broadcast(df), "term")
    idf = F.log(1 + (ix.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(ix.mean_length or 1.0)))
    out = hits.groupBy("id").agg(F.round(F.sum(part), DIGITS).alias("fts_score")).orderBy(F.col("fts_score").desc(), "id")
    return out if limit is None else out.limit(max(1, limit))
