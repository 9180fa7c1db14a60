"""The store: a folder with one metadata JSON, and folders of Parquet runs for each track.

Every write goes to a new folder, and counts from when the metadata names it: that is
replaced in one rename. What a crash leaves behind is read by nobody.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.grammar import human_bytes
from ..plans.reference import Reference, bin_width, reserved
from ..plans.track import Track
from .files import delete, exists, open_path, read_file, replace_file
from .text import SPARK_TYPES, last_wins, safe_name

VERSION = "2"
META = "store.json"
COLUMNS = ["contig", "start", "end", "label", "value"]
TYPES = {*SPARK_TYPES.values(), "bigint", "tinyint", "smallint"}


class StoreError(Exception):
    """A store that can't be read or written as asked."""


class UnsupportedVersion(StoreError):
    """A store that another version of the library wrote."""


def _read_meta(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/{META}"):
        raise FileNotFoundError(path)
    meta = json.loads(read_file(spark, f"{path}/{META}"))
    if meta.get("version") != VERSION:
        raise UnsupportedVersion(f"unsupported version {meta.get('version')!r}")
    return meta


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """The commit point of every change."""
    replace_file(spark, f"{path}/{META}", json.dumps(meta, indent=1))


class Store:
    """An opened store. Tracks are read lazily; ``tracks`` limits which ones are seen."""

    def __init__(self, spark: SparkSession, path: str, tracks=None, read_only: bool = True):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.meta = _read_meta(spark, self.path)
        self.reference = Reference(self.meta["reference"])
        if unknown := set(tracks or ()) - set(self.meta["tracks"]):
            raise ValueError(f"unknown tracks {sorted(unknown)}")
        self.names = [n for n in self.meta["tracks"] if tracks is None or n in tracks]

    def __getitem__(self, name: str) -> Track:
        if name not in self.names:
            raise KeyError(name)
        t = self.meta["tracks"][name]
        if not t["layers"]:
            runs = self.spark.read.parquet(*[f"{self.path}/{x}" for x in t["folders"]])
            return Track(runs, self.reference, tuple(t["labels"]), t["fill"], t["dim"])
        # Rows were added to columns that were there: where bases are stored again, the later folder's count.
        runs = None
        for line, folder in enumerate(t["folders"]):
            part = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("line", F.lit(line))
            runs = part if runs is None else runs.unionByName(part)
        return Track(last_wins(runs, self.reference.bucket()), self.reference, tuple(t["labels"]), t["fill"], t["dim"])

    def only(self) -> Track:
        """The track of a store that has one."""
        if len(self.names) != 1:
            raise ValueError(f"name one of the tracks {self.names}")
        return self[self.names[0]]

    def write(self, tracks: dict[str, Track], file_rows: int | None = None, compression: str = "zstd") -> None:
        """Add tracks; nothing is overwritten, and a failure leaves no part behind.

        ``file_rows`` bounds the runs of a file, ``compression`` is Parquet's; the track's
        later files are written likewise.
        """
        if file_rows is not None and file_rows < 1:
            raise ValueError("a file holds one run at least")
        layout = {"file_rows": file_rows, "compression": compression}
        self._writable()
        for name, t in tracks.items():
            if reserved(name) or not safe_name(name):
                raise ValueError(f"{name!r} can't name a track")
            if name in self.meta["tracks"]:
                raise FileExistsError(name)
            if t.reference != self.reference:
                raise ValueError(f"{name} has another reference")
            if len(set(t.labels)) < len(t.labels):
                raise ValueError(f"labels of {name} repeat")
            if t.runs.schema["value"].dataType.simpleString() not in TYPES:
                raise ValueError(f"{name} is of a type that can't be stored")
            same = [o for o in [*self.meta["tracks"].values(), *[{"dim": o.dim, "labels": list(o.labels)} for o in tracks.values()]] if o["dim"] == t.dim and t.labels != ("",) and o["labels"] != [""]]
            if any(o["labels"] != list(t.labels) for o in same):
                raise ValueError(f"{name} disagrees with the store on {t.dim}")
        added = {}
        with self._cleaning() as done:
            for name, t in tracks.items():
                added[name] = {"labels": list(t.labels), "fill": t.fill, "dim": t.dim, "dtype": t.runs.schema["value"].dataType.simpleString(), "id": uuid.uuid4().hex, "layers": False, "layout": layout, "folders": [self._save(t, name, done, layout)]}
            self._commit({**self.meta, "tracks": {**self.meta["tracks"], **added}})
        self.names += list(tracks)

    def append(self, name: str, more: Track, batch: tuple[str, int] | None = None) -> bool:
        """Add columns to a track; every other track of that dimension gets them too, reading as its fill.

        ``batch`` (a name and a number that grows) makes a replay of the same batch do
        nothing; then rows of columns that are there already are taken too: bases that
        they hold are theirs from now on. False if there was nothing to do.
        """
        self._writable()
        t = self.meta["tracks"][name]
        if batch and self.meta.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return False
        if t["labels"] == [""]:
            raise ValueError(f"{name} has no column axis")
        again = set(more.labels) & set(t["labels"])
        if again and not batch:
            raise ValueError("labels are there already")
        if more.reference != self.reference or more.fill != t["fill"] or more.runs.schema["value"].dataType.simpleString() != t["dtype"]:
            raise ValueError("appended columns differ in reference, fill or type")
        fresh = [x for x in more.labels if x not in t["labels"]]
        meta = json.loads(json.dumps(self.meta))
        with self._cleaning() as done:
            own = meta["tracks"][name]
            # A layer that may cover stored bases keeps its fill's runs too: they count.
            own["folders"].append(self._save(more, name, done, own["layout"], bool(again)))
            own["layers"] = own["layers"] or bool(again)
            for other in meta["tracks"].values():
                if other["dim"] == t["dim"] and other["labels"] != [""]:
                    other["labels"] += fresh
            if batch:
                meta.setdefault("batches", {})[batch[0]] = batch[1]
            self._commit(meta)
        return True

    def compact(self, name: str) -> None:
        """Rewrite a track as one folder, without what later rows replaced."""
        self._writable()
        old, meta = self.meta["tracks"][name]["folders"], json.loads(json.dumps(self.meta))
        with self._cleaning() as done:
            meta["tracks"][name] |= {"folders": [self._save(self[name], name, done, meta["tracks"][name]["layout"])], "layers": False}
            self._commit(meta)
        for folder in old:
            delete(self.spark, f"{self.path}/{folder}")

    def _writable(self) -> None:
        if self.read_only:
            raise StoreError("the store is open for reading")

    def _commit(self, meta: dict) -> None:
        _write_meta(self.spark, self.path, meta)
        self.meta = meta

    @contextmanager
    def _cleaning(self):
        """A list of folders that are deleted on failure."""
        done: list[str] = []
        try:
            yield done
        except BaseException:
            for folder in done:
                delete(self.spark, f"{self.path}/{folder}")
            raise

    def _save(self, track: Track, name: str, done: list[str], layout: dict, all_runs: bool = False) -> str:
        """Write a track's runs, but those of its fill, to a new folder."""
        folder = f"{name}/{uuid.uuid4().hex}"
        done.append(folder)
        runs = track.runs if track.fill is None or all_runs else track.runs.where(~F.col("value").eqNullSafe(F.lit(track.fill)))
        # Clustered by place, so that row groups' bounds prune scans of a locus.
        ordered = runs.select(*COLUMNS).repartitionByRange("contig", "label", "start").sortWithinPartitions("contig", "label", "start")
        ordered.write.mode("errorifexists").option("compression", layout["compression"]).option("maxRecordsPerFile", layout["file_rows"] or 0).parquet(f"{self.path}/{folder}")
        return folder

    def info(self) -> dict:
        """Reference, and for each track its labels, fill, type and bytes."""
        fs, _ = open_path(self.spark, self.path)
        sizes = {n: sum(fs.getContentSummary(open_path(self.spark, f"{self.path}/{x}")[1]).getLength() for x in self.meta["tracks"][n]["folders"]) for n in self.names}
        contigs = list(self.reference.items())
        return {
            "version": VERSION, "contigs": contigs[:10], "more_contigs": max(0, len(contigs) - 10), "positions": self.reference.total, "digest": self.reference.digest,
            "tracks": {n: {k: v for k, v in self.meta["tracks"][n].items() if k not in ("folders", "layers")} | {"bytes": sizes[n], "size": human_bytes(sizes[n])} for n in self.names},
        }


def create(spark: SparkSession, path: str, reference: Reference) -> Store:
    """An empty store; an existing path is refused."""
    path = path.rstrip("/")
    if exists(spark, path):
        raise FileExistsError(path)
    fs, p = open_path(spark, path)
    fs.mkdirs(p)
    _write_meta(spark, path, {"version": VERSION, "id": uuid.uuid4().hex, "reference": list(reference.items()), "tracks": {}, "batches": {}})
    return Store(spark, path, read_only=False)


def open_store(spark: SparkSession, path: str, tracks=None, read_only: bool = True) -> Store:
    return Store(spark, path, tracks, read_only)


def pack(spark: SparkSession, path: str, target: str) -> None:
    """Write a store as one zip file (stored, Zip64 where needed) that a local path names: beside it first, then renamed."""
    path = path.rstrip("/")
    meta, fs = _read_meta(spark, path), open_path(spark, path)[0]
    if os.path.exists(target):
        raise FileExistsError(target)
    temp = f"{target}.{uuid.uuid4().hex}"
    try:
        with zipfile.ZipFile(temp, "w", zipfile.ZIP_STORED, allowZip64=True) as out:
            for folder in [x for t in meta["tracks"].values() for x in t["folders"]]:
                for status in fs.listStatus(open_path(spark, f"{path}/{folder}")[1]):
                    name = status.getPath().getName()
                    if name.endswith(".parquet"):
                        _copy_in(spark, f"{path}/{folder}/{name}", out, f"{folder}/{name}")
            out.writestr(META, json.dumps(meta))
        os.replace(temp, target)
    finally:
        if os.path.exists(temp):
            os.remove(temp)


def _copy_in(spark: SparkSession, path: str, out: zipfile.ZipFile, name: str, piece: int = 1 << 22) -> None:
    fs, p = open_path(spark, path)
    source = fs.open(p)
    try:
        with out.open(name, "w", force_zip64=True) as sink:
            left = fs.getFileStatus(p).getLen()
            while left:
                block = bytes(source.readNBytes(min(left, piece)))
                sink.write(block)
                left -= len(block)
    finally:
        source.close()


def open_zip(spark: SparkSession, source: str, folder: str, tracks=None) -> Store:
    """Open a zip file of pack() for reading: its files are unpacked below ``folder``, which all executors must see."""
    if not zipfile.is_zipfile(source):
        raise StoreError(f"{source} is no zip file")
    at = posixpath.join(folder, f"{os.path.basename(source)}-{uuid.uuid4().hex}")
    fs, _ = open_path(spark, at)
    with zipfile.ZipFile(source) as archive:
        for name in archive.namelist():
            if name.startswith("/") or ".." in name.split("/"):
                raise StoreError(f"bad name {name!r} in {source}")
            out = fs.create(open_path(spark, f"{at}/{name}")[1], True)
            try:
                with archive.open(name) as entry:
                    while block := entry.read(1 << 22):
                        out.write(bytearray(block))
            finally:
                out.close()
    return Store(spark, at, tracks)


def validate(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(valid, invalid, incomplete or unsupported_version; findings), each finding with its rule. Metadata and schemas only; no values are read.

    R1 root and version, R2 a reference, R4 its names, R5 integer lengths, R6 their
    range and sum; D1 distinct axes, D2 one extent of a dimension, D3 unique labels, D4
    names; G1 reserved names, G3 one genomic axis, first; ``encoding`` types and fills.
    """
    path = path.rstrip("/")
    try:
        meta = _read_meta(spark, path)
    except FileNotFoundError:
        return "incomplete", ["R1: no metadata"]
    except UnsupportedVersion as e:
        return "unsupported_version", [f"R1: {e}"]
    except ValueError as e:
        return "invalid", [f"R1: metadata is not JSON: {e}"]
    found = _check_reference(meta)
    tracks = meta.get("tracks")
    if not isinstance(tracks, dict):
        return "invalid", [*found, "R1: no tracks"]
    by_dim: dict = {}
    for name, t in tracks.items():
        missing = [k for k in ("labels", "fill", "dim", "dtype", "folders") if k not in t]
        if missing:
            found.append(f"D1: {name} lacks {', '.join(missing)}")
            continue
        if reserved(name):
            found.append(f"G1: {name}: reserved name")
        elif not safe_name(name):
            found.append(f"D4: {name!r} can't name a track")
        if t["dim"] in tracks and t["labels"] != [""]:
            found.append(f"D4: {name}: {t['dim']} names a track too")
        if reserved(t["dim"]) or bin_width(t["dim"]):
            found.append(f"G3: {name}: a second genomic axis {t['dim']}")
        if len(set(t["labels"])) < len(t["labels"]) or any(not isinstance(x, str) for x in t["labels"]) or (len(t["labels"]) > 1 and "" in t["labels"]):
            found.append(f"D3: {name}: labels repeat or are missing")
        if t["labels"] != [""] and by_dim.setdefault(t["dim"], t["labels"]) != t["labels"]:
            found.append(f"D2: {name}: {t['dim']} has several extents")
        if t["dtype"] not in TYPES:
            found.append(f"encoding: {name}: type {t['dtype']}")
        if t["fill"] is not None and (t["dtype"] == "boolean") != isinstance(t["fill"], bool):
            found.append(f"encoding: {name}: fill {t['fill']!r} is not of type {t['dtype']}")
        if t["fill"] is not None and t["dtype"] not in ("float", "double", "boolean") and not isinstance(t["fill"], int):
            found.append(f"encoding: {name}: fill {t['fill']!r} is no integer")
        lost = [x for x in t["folders"] if not exists(spark, f"{path}/{x}")]
        if lost or not t["folders"]:
            return "incomplete", [*found, f"{name}: no data"]
        schema = spark.read.parquet(f"{path}/{t['folders'][0]}").schema
        if schema.names != COLUMNS or schema["value"].dataType.simpleString() != t["dtype"]:
            found.append(f"encoding: {name}: columns")
    return ("invalid" if found else "valid"), found


def _check_reference(meta: dict) -> list[str]:
    contigs = meta.get("reference")
    if not isinstance(contigs, list) or not contigs or any(not isinstance(x, list) or len(x) != 2 for x in contigs):
        return ["R2: no reference of names and lengths"]
    names, lengths, found = [x[0] for x in contigs], [x[1] for x in contigs], []
    if any(not isinstance(n, str) or not n for n in names) or len(set(map(str, names))) < len(names):
        found.append("R4: contig names must be unique and not empty")
    if any(isinstance(x, bool) or not isinstance(x, int) for x in lengths):
        found.append("R5: contig lengths must be integers")
    elif any(x < 0 for x in lengths) or sum(lengths) >= 1 << 63:
        found.append("R6: contig lengths must not be negative, and their sum below 2**63")
    return found
