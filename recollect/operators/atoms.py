"""An inverted index of verbatim atoms (paths, addresses, ids, commands, errors), written file by file.

Extraction runs once over each file of a table. A file that is new, or was written again, is read at the next update; what
a replaced or removed file gave no longer counts. Each update writes a folder and then a list of the files that are valid;
the list is the commit, so an update that is cut short leaves nothing behind that counts.

Rows lie twice: dealt by atom for those who look for an atom, and by memory for those who look for a memory's atoms.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import python_lex_tokens
from recollect.sources.files import listing, place, remove

#: Class of atom: pattern, and what a line must hold to be looked at. The first group, if there is one, is the atom.
CLASSES: dict[str, tuple[str, str]] = {
    "path": (r"(?:^|[\s\"'(=])((?:/[A-Za-z0-9._-]+){2,})", "/"),
    "url": (r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "://"),
    "uuid": (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "-"),
    "hex": (r"[0-9a-f]{12,40}", ""),
    "issue": (r"(?:^|[\s(])(#[0-9]+)", "#"),
    "file:line": (r"[A-Za-z0-9_./-]+\.[A-Za-z]{1,4}:[0-9]+", ":"),
    "bash": (r"^\s*\$ ([^\r\n]+)", "$ "),
    "error": (r"[A-Za-z]*(?:Error|Exception|error|fatal|panic): [^\r\n]+", ": "),
    "email": (r"[a-z0-9._]+@[a-z0-9.-]+[a-z]", "@"),
    "key": (r"AKIA[A-Z0-9]{16}", "AKIA"),
}
SECRET = r"(?i)((?:password|passwd|secret|token|api_?key)\s*[=:]\s*)(\S+)"
ROWS_OF_A_BUCKET = 2_000_000
FILES = "origin string, path string, state string, batch string, buckets int"
ROWS = "origin string, memory_id long, realm string, class string, atom string, n long, line int, redacted boolean, file string"


def extract(rows: DataFrame) -> DataFrame:
    """class, atom, n, line, redacted of each text's atoms, beside the other columns of rows (which must not have these names).

    line is the first one, from 1, that holds the atom, n how often the text does. Values that follow the name of a
    secret are struck out.
    """
    others = [c for c in rows.columns if c != "text"]
    lines = rows.select(*others, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    said = F.col("said")
    none = F.array().cast("array<struct<class:string,atom:string>>")

    def found(name: str) -> Column:
        pattern, needs = CLASSES[name]
        group = 1 if re.search(r"\((?!\?)", pattern) else 0
        each = F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(group)), lambda a: F.struct(F.lit(name).alias("class"), a.alias("atom")))
        return F.when(said.contains(needs), each).otherwise(none) if needs else each

    atoms = lines.select(*others, (F.col("line") + 1).alias("line"), F.explode(F.concat(*map(found, CLASSES))).alias("a"))
    clean = F.regexp_replace("a.atom", SECRET, "$1[redacted]")
    atoms = atoms.select(*others, F.col("a.class").alias("class"), clean.alias("atom"), "line", (clean != F.col("a.atom")).alias("redacted"))
    return atoms.groupBy(*others, "class", "atom").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.bool_or("redacted").alias("redacted"))


class AtomIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: list[tuple[str, str, str, str, int]] | None = None

    def _versions(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/files")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [x.getName() for x in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(done)

    def _valid(self) -> list[tuple[str, str, str, str, int]]:
        """(origin, path, state, batch, buckets) of the files that count: as many rows as files."""
        if self._known is None:
            versions = self._versions()
            self._known = [tuple(r) for r in self.spark.read.schema(FILES).parquet(f"{self.folder}/files/{versions[-1]}").collect()] if versions else []
        return self._known

    def update(self, origin: str, root: str, read: Callable[[DataFrame], DataFrame]) -> int:
        """Bring the index up to date with a table; read makes memory_id, realm and text of its rows. Returns how many files were read."""
        self._known = None  # another session may have brought it up to date
        now, valid = {path: state for path, (state, _) in listing(self.spark.read.parquet(root)).items()}, self._valid()
        kept = [r for r in valid if r[0] != origin or now.get(r[1]) == r[2]]
        new = sorted(set(now) - {r[1] for r in kept if r[0] == origin})
        if not new and len(kept) == len(valid):
            return 0
        batch = uuid.uuid4().hex
        buckets = 1
        if new:
            table = self.spark.read.parquet(*new).withColumn("_file", place(F.col("_metadata.file_path")))
            rows = read(table).select("memory_id", F.coalesce("realm", F.lit("")).alias("realm"), "text", F.col("_file").alias("file"))
            found = extract(rows).select(F.lit(origin).alias("origin"), "memory_id", "realm", "class", "atom", "n", "line", "redacted", "file")
            plain = f"{self.folder}/found/{batch}"
            found.write.parquet(plain)
            found = self.spark.read.schema(ROWS).parquet(plain)
            buckets = found.count() // ROWS_OF_A_BUCKET + 1
            for layout, key in (("by_atom", F.crc32("atom")), ("by_memory", F.crc32(F.col("memory_id").cast("string")))):
                dealt = found.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int"))
                # Rows of a frequent atom share a bucket's folder but not a task.
                dealt.repartition(4 * buckets, "bucket", F.pmod("memory_id", F.lit(4))).sortWithinPartitions("class", "atom").write.partitionBy("bucket").parquet(f"{self.folder}/{layout}/{batch}")
            remove(found, plain)
        listed = [*kept, *((origin, path, now[path], batch, buckets) for path in new)]
        version = f"{len(self._versions()):08d}-{batch}"
        self.spark.createDataFrame(listed, FILES).coalesce(1).write.parquet(f"{self.folder}/files/{version}")
        self._known = listed
        return len(new)

    def rows(self, origin: str | None = None, layout: str = "by_atom") -> DataFrame:
        """origin, memory_id, realm, class, atom, n, line, redacted, file, bucket of the files that count."""
        valid = [r for r in self._valid() if origin in (None, r[0])]
        found = None
        for batch in sorted({r[3] for r in valid}):
            part = self.spark.read.schema(f"{ROWS}, bucket int").parquet(f"{self.folder}/{layout}/{batch}")
            # A batch of which every file still counts needs no look at the files of its rows.
            own = [r[1] for r in valid if r[3] == batch]
            part = part.where(F.col("file").isin(own)) if len(own) <= 1000 else part.join(self.spark.createDataFrame([(x,) for x in own], "file string"), "file", "left_semi").select(*part.columns)
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], f"{ROWS}, bucket int") if found is None else found

    def query(self, asked: str, realm: str | None = None, k: int = 6, origin: str | None = None) -> DataFrame:
        """class, atom, count, session, line, memory_id of the atoms that hold what is asked for or all its tokens; the k most frequent, newest first among equals.

        Session, line and id are those of the newest memory with the atom.
        """
        rows = self.rows(origin)
        low, tokens = F.lower("atom"), python_lex_tokens(asked)
        hit = low.contains(asked.lower())
        if tokens:
            alike = F.lit(True)
            for t in tokens:
                alike = alike & low.rlike(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])")
            hit = hit | alike
        rows = rows.where(hit) if realm is None else rows.where(hit & (F.col("realm") == realm))
        by = rows.groupBy("class", "atom").agg(F.sum("n").alias("count"), F.max(F.struct("memory_id", "realm", F.negate("line").alias("line"))).alias("last"))
        best = by.orderBy(F.desc("count"), F.desc("last.memory_id"), "class", "atom").limit(k)
        return best.select("class", "atom", "count", F.col("last.realm").alias("session"), F.negate("last.line").alias("line"), F.col("last.memory_id").alias("memory_id"))

    def stats(self, origin: str | None = None) -> DataFrame:
        """class, atoms, mentions, bytes, redacted: distinct atoms of each class, how often they occur, their size, and how often something was struck out."""
        each = self.rows(origin).groupBy("class", "atom").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("redacted"), F.col("n")).otherwise(0)).alias("redacted"))
        return each.groupBy("class").agg(F.count("*").alias("atoms"), F.sum("n").alias("mentions"), F.sum(F.octet_length("atom")).cast("long").alias("bytes"), F.sum("redacted").alias("redacted"))

    def partners(self, anchors: DataFrame, n: DataFrame, most: int, origin: str | None = None) -> DataFrame:
        """anchor, memory_id, w, place: for each anchor (memory_id, of which there are few) the memories that share its atoms, the rarest
        counting most, and the place of each among them. n is one row with the number of memories."""
        own = self.rows(origin, "by_memory").join(F.broadcast(anchors.select("memory_id")), "memory_id").select(F.col("memory_id").alias("anchor"), "class", "atom").distinct()
        return weighed(own, self.rows(origin).select("memory_id", "class", "atom").distinct(), n, most)


def weighed(own: DataFrame, every: DataFrame, n: DataFrame, most: int) -> DataFrame:
    """partners() of anchors with their atoms (anchor, class, atom) among all memories with theirs (memory_id, class, atom)."""
    met = every.join(own, ["class", "atom"])
    df = met.groupBy("class", "atom").agg(F.countDistinct("memory_id").alias("df"))
    weights = met.where("memory_id <> anchor").join(df, ["class", "atom"]).join(F.broadcast(n)).groupBy("anchor", "memory_id").agg(F.round(F.sum(F.log(F.col("n") / F.col("df"))), 9).alias("w"))
    at = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("w"), "memory_id"))
    return weights.withColumn("place", at).where(F.col("place") <= most)
