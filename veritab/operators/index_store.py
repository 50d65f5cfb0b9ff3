"""A retrieval index that follows its files.

Files (file, version, text) are cut into chunks and tokenised once for each version, into an immutable segment: its chunks,
the bag of each chunk's terms, its posting lists by term, its terms with their document frequencies, and its files. A commit
names the live versions and their segments; what a segment holds of other versions is dead. Document frequencies are the
segments' sums less those of the dead bags, so a refresh tokenises only new and changed files and counts only what came and
went.

As every weight rests on the number of chunks and on document frequencies, each commit finds the norms of all live chunks anew,
which reads bags, never texts, and shuffles one row for each chunk; postings stay as their segment wrote them. A query reads its
own terms' lists of each segment, and the norms, which only live chunks have, weigh them and leave the dead ones out. Commits
are whole folders, marked when they are complete: a reader keeps its own commit while the next is made, and a refresh that
dies leaves no trace that a reader sees.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.retrieval import bags, by_term, chunks, flat, idf, posting_lists, row_norms
from veritab.sources.store import written

KEYS = ["file", "ordinal"]
#: Segments that a commit has at most before they are merged, and dead files for each live one.
SEGMENTS, DEAD_SHARE = 12, 0.5
#: A list of dead files with at most so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass
class Snapshot:
    """One commit: what `retrieval.retrieve` takes as its index, with the chunks and files that it covers. postings are those of
    its segments, weights the norms (segment, file, ordinal, norm) of the live chunks."""

    keys: list[str]
    postings: DataFrame
    weights: DataFrame
    terms: DataFrame
    chunks: DataFrame
    files: DataFrame
    rows: int

    def search(self, query: list[str]) -> DataFrame:
        """(file, ordinal, score): cosine under TF-IDF weights of each chunk that has a query term."""
        times = {q: float(query.count(q)) for q in dict.fromkeys(query)}
        if not times:
            return self.weights.select(*self.keys, F.lit(0.0).alias("score")).limit(0)
        asked = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("term"))
        known = self.terms.where(F.col("term").isin(*times))
        more = known.select((F.pow(asked * F.col("idf"), 2) - F.pow(asked * F.lit(float(unseen(self.rows))), 2)).alias("more"))
        all_unseen = sum((k * unseen(self.rows)) ** 2 for k in times.values())
        norm = more.agg(F.sqrt(F.greatest(F.lit(1e-300), F.lit(all_unseen) + F.coalesce(F.sum("more"), F.lit(0.0))))).scalar()
        own = self.postings.where(F.col("term").isin(*times)).select("segment", "term", F.inline(F.arrays_zip(*self.keys, "tf")))
        at = ["segment", *self.keys]
        weighed = own.join(F.broadcast(known.select("term", (F.col("idf") * F.col("idf") * asked).alias("factor"))), "term")
        dots = weighed.groupBy(*at).agg(F.sum(F.col("tf") * F.col("factor")).alias("dot"))
        return dots.join(self.weights, at).select(*self.keys, (F.col("dot") / (F.col("norm") * norm)).alias("score"))


def unseen(rows: int) -> float:
    """The weight of a term that no chunk has."""
    import math

    return math.log(rows + 1) + 1


@dataclass
class Refresh:
    """What a refresh did: files that were tokenised, taken out, and left as they were; the commit it made, or the one that
    still holds."""

    added: int
    removed: int
    kept: int
    commit: int


class IndexStore:
    """The index under a folder that the whole cluster can reach. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: (segments, live files, dead files, chunks) of the commits that this object has looked at; commits never change.
        self._known: dict[int, tuple[list[str], int, int, int]] = {}
        self._snapshots: dict[int, Snapshot] = {}

    # Files and folders, in whatever store they are.

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _store(self):
        return self._path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        store, at = self._store(), self._path(*parts)
        return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []

    def _read(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet("/".join((self.folder, *parts)))

    def commits(self) -> list[int]:
        """The complete commits, oldest first."""
        store = self._store()
        return sorted(int(n) for n in self._names("commits") if store.exists(self._path("commits", n, "_DONE")))

    def latest(self) -> int | None:
        return (self.commits() or [None])[-1]

    def files(self, commit: int) -> DataFrame:
        """(file, version, chunks, segment): what is live in a commit."""
        return self._read("commits", str(commit), "files")

    def snapshot(self, commit: int | None = None) -> Snapshot:
        commit = self.latest() if commit is None else commit
        if commit is None:
            raise ValueError("the index has no commit yet")
        if commit not in self._snapshots:
            at = lambda kind: self._read("commits", str(commit), kind)
            postings = self._together("postings", self._told(commit)[0], self.files(commit))
            self._snapshots[commit] = Snapshot(KEYS, postings, at("weights"), at("terms"), self._live("chunks", commit), self.files(commit), self._told(commit)[3])
        return self._snapshots[commit]

    # Segments.

    def _told(self, commit: int) -> tuple[list[str], int, int, int]:
        """Segments, live files, dead files and live chunks of a commit, in two small jobs."""
        if commit not in self._known:
            told = self.files(commit).groupBy("segment").agg(F.count("*").alias("n"), F.sum("chunks").alias("chunks")).collect()
            names, live = sorted(r["segment"] for r in told), sum(r["n"] for r in told)
            every = self._together("files", names, self.files(commit)).count() if names else 0
            self._known[commit] = names, live, every - live, sum(r["chunks"] for r in told)
        return self._known[commit]

    def _live(self, kind: str, commit: int) -> DataFrame:
        """The rows of a kind of a commit's segments without those of dead files."""
        names, _, dead, _ = self._told(commit)
        every = self._together(kind, names, self.files(commit))
        return (every.join(self._dead(self.files(commit), names, dead), ["segment", "file"], "left_anti") if dead else every).drop("segment")

    def _together(self, kind: str, names: list[str], like: DataFrame) -> DataFrame:
        if not names:
            empty = {"chunks": "file {0}, ordinal int, words int, chunk string", "bags": "file {0}, ordinal int, terms array<string>, tfs array<int>", "postings": "term string, file array<{0}>, ordinal array<int>, tf array<int>", "terms": "term string, df long", "files": "file {0}, version string, chunks long"}[kind]
            return self.spark.createDataFrame([], empty.format(like.schema["file"].dataType.simpleString()) + ", segment string")
        return reduce(DataFrame.unionByName, [self._read("segments", n, kind).withColumn("segment", F.lit(n)) for n in names])

    def _dead(self, files: DataFrame, names: list[str], n: int) -> DataFrame:
        """(segment, file): the n files that segments hold and that are not live."""
        dead = self._together("files", names, files).join(files.select("segment", "file"), ["segment", "file"], "left_anti").select("segment", "file")
        return F.broadcast(dead) if n <= BROADCAST_ROWS else dead

    def _add_segment(self, texts: DataFrame) -> str:
        """Cuts and tokenises (file, version, text) into a new segment."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/segments/{name}"
        cut = written(chunks(texts, "file"), f"{at}/chunks")
        sizes = cut.groupBy("file").agg(F.count("*").alias("chunks"))
        files = texts.select("file", "version").join(sizes, "file", "left").select("file", "version", F.coalesce("chunks", F.lit(0)).alias("chunks"))
        return self._finish(name, bags(cut, KEYS, "chunk"), files)

    def _finish(self, name: str, own: DataFrame, files: DataFrame) -> str:
        at = f"{self.folder}/segments/{name}"
        own = written(own, f"{at}/bags")
        written(by_term(posting_lists(own, KEYS), KEYS[0]), f"{at}/postings")
        written(flat(own, []).groupBy("term").agg(F.count("*").alias("df")), f"{at}/terms")
        written(files, f"{at}/files")
        return name

    # Commits.

    def refresh(self, docs: DataFrame) -> Refresh:
        """Brings the index to the state of docs (file, version, text): only files that are new or of a new version are
        tokenised. A file stands once in docs and is not null; any null version is one version. Without a change no commit
        is made."""
        docs = docs.select("file", F.coalesce(F.col("version").cast("string"), F.lit("")).alias("version"), "text")
        before = self.latest()
        key = docs.schema["file"].dataType.simpleString()
        same = ["file", "version"]
        if before is None:
            old = self.spark.createDataFrame([], f"file {key}, version string, chunks long, segment string")
            n_old, n_kept, n_fresh = 0, 0, docs.count()
        else:
            old = self.files(before)
            both = old.select(*same, F.lit(1).alias("had")).join(docs.select(*same, F.lit(1).alias("has")), same, "full")
            n_old, n_kept, n_fresh = both.agg(F.count("had"), F.count_if(F.col("had") == F.col("has")), F.count_if(F.col("had").isNull())).first()
            if n_kept == n_old and not n_fresh:
                return Refresh(0, 0, n_kept, before)
        kept = old.join(docs.select(*same), same, "left_semi")
        # Only keys are compared; a text is not shuffled unless very many files changed.
        changed = docs.select(*same).join(old.select(*same), same, "left_anti")
        fresh = docs if before is None else docs.join(F.broadcast(changed) if n_fresh <= BROADCAST_ROWS else changed, same, "left_semi")
        if n_fresh:
            name = self._add_segment(fresh)
            kept = kept.unionByName(self._read("segments", name, "files").withColumn("segment", F.lit(name)))
        commit = self._commit((before or 0) + 1, kept)
        names, live, dead, _ = self._told(commit)
        if len(names) > SEGMENTS or dead > DEAD_SHARE * max(1, live):
            commit = self.compact()
        return Refresh(n_fresh, n_old - n_kept, n_kept, commit)

    def compact(self) -> int:
        """Merges the live rows of all segments into one, without reading a text anew; the commit that names it."""
        last = self.latest()
        files = self.files(last)
        name = uuid.uuid4().hex
        written(self._live("chunks", last), f"{self.folder}/segments/{name}/chunks")
        self._finish(name, self._live("bags", last), files.select("file", "version", "chunks"))
        return self._commit(last + 1, files.withColumn("segment", F.lit(name)))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the newest commits, and the segments that none of those names; what was deleted."""
        held = self.commits()[-keep:]
        used = {s for c in held for s in self._told(c)[0]}
        gone = [f"commits/{n}" for n in self._names("commits") if not n.isdigit() or int(n) not in held]
        gone += [f"segments/{n}" for n in self._names("segments") if n not in used]
        for path in gone:
            self._store().delete(self._path(path), True)
        return gone

    def _commit(self, number: int, files: DataFrame) -> int:
        at = f"{self.folder}/commits/{number}"
        self._store().delete(self._path("commits", str(number)), True)  # of a refresh that died
        self._known.pop(number, None)
        self._snapshots.pop(number, None)
        files = written(files.select("file", "version", "chunks", "segment"), f"{at}/files")
        names, _, n_dead, rows = self._told(number)
        every = self._together("bags", names, files)
        terms = self._together("terms", names, files).select("term", "df")
        if n_dead:
            gone = every.join(self._dead(files, names, n_dead), ["segment", "file"], "left_semi")
            terms = terms.unionByName(flat(gone, []).groupBy("term").agg((-F.count("*")).alias("df")))
            every = every.join(self._dead(files, names, n_dead), ["segment", "file"], "left_anti")
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        terms = written(terms.withColumn("idf", idf(F.lit(rows), F.col("df"))).sort("term"), f"{at}/terms")
        written(row_norms(every, ["segment", *KEYS], terms, rows), f"{at}/weights")
        self._store().create(self._path("commits", str(number), "_DONE"), True).close()
        return number
