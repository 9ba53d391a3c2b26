"""Paths: scans of folders, files and lists, checks, pairs of image and page, file actions."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import pagetext as T


def cleaned(paths: str | os.PathLike | Sequence[str | os.PathLike]) -> list[str]:
    """One or several paths as a list of strings."""
    if not paths:
        raise ValueError("no path given")
    if isinstance(paths, (str, os.PathLike)):
        return [os.fspath(paths)]
    if not isinstance(paths, Sequence):
        raise TypeError(f"neither a path nor a sequence of paths: {paths!r}")
    for p in paths:
        if not isinstance(p, (str, os.PathLike)):
            raise TypeError(f"not a path: {p!r}")
    return [os.fspath(p) for p in paths]


def accessible(path: str) -> None:
    """An error if a path is not there or cannot be read."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not os.access(path, os.R_OK):
        raise PermissionError(path)


def scanned(spark: SparkSession, paths, suffixes: Iterable[str], empty_ok: bool = True) -> DataFrame:
    """(path, stem) in natural order: the files with these suffixes of each path, which is a folder (its own files only), a file, or a .txt list.

    A list has a path per line, relative to the list's folder, each of which is any of the three again. The lists are
    read on the driver, as is the listing; what they name becomes a table.
    """
    wanted = {s.lower() for s in suffixes}
    if not wanted:
        raise ValueError("no suffixes given")
    todo, found, open_lists = [(p, ()) for p in reversed(cleaned(paths))], [], 0
    while todo:
        path, above = todo.pop()
        path = os.path.realpath(os.path.expanduser(path))
        accessible(path)
        suffix = os.path.splitext(path)[1].lower()
        if os.path.isdir(path):
            got = [e.path for e in os.scandir(path) if os.path.splitext(e.name)[1].lower() in wanted]
        elif suffix in wanted:
            got = [path]
        elif suffix == ".txt":
            if path in above:
                raise ValueError(f"a list that names itself: {path}")
            with open(path, encoding="utf-8") as f:
                got = [os.path.join(os.path.dirname(path), line) for line in f.read().splitlines() if line]
            todo += [(p, (*above, path)) for p in reversed(got)]
            open_lists += 1
        else:
            raise ValueError(f"neither a folder, a list nor one of {sorted(wanted)}: {path}")
        if not got and not empty_ok:
            raise FileNotFoundError(f"nothing in {path}")
        if suffix != ".txt" or suffix in wanted:
            found += got
    rows = spark.createDataFrame([(p,) for p in found], "path string")
    return rows.select("path", T.stem(F.col("path")).alias("stem")).orderBy(T.natural_key(F.col("path")), "path")


def listing(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(path, length, stem) of the files under a folder at any depth with these suffixes, in natural order of names; listed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    of = files.filter(T.suffix(F.col("path")).isin([s.lower() for s in suffixes]))
    return of.select("path", "length", T.stem(F.col("path")).alias("stem")).orderBy(T.natural_key(F.col("path")), "path")


def missing(wanted: DataFrame, there: DataFrame, column: str = "path") -> DataFrame:
    """The paths that are wanted and not there."""
    return wanted.join(there.select(column), column, "left_anti")


def xml_beside(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(image, xml) of images (path): the page of the same stem in the folder `page` beside the image, null if there is none. Pages: (path)."""
    own = images.select(F.col("path").alias("image"), T.xml_path(F.col("path")).alias("xml"))
    return own.join(pages.select(F.col("path").alias("xml"), F.lit(True).alias("_there")), "xml", "left").select("image", F.when(F.col("_there"), F.col("xml")).alias("xml"))


def image_beside(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(xml, image) of pages dir/page/stem.xml: the first image by name with exactly that stem in dir, null if there is none."""
    folder = lambda c, up: F.regexp_replace(c, r"/[^/]*" * up + "$", "")
    own = pages.select(F.col("path").alias("xml"), folder(F.col("path"), 2).alias("_dir"), T.stem(F.col("path")).alias("_stem"))
    of = images.groupBy(folder(F.col("path"), 1).alias("_dir"), T.stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("image"))
    return own.join(of, ["_dir", "_stem"], "left").select("xml", "image")


def unique(path: str) -> str:
    """The path, or with (n) before its suffix, the least n from 1 that is free."""
    if not os.path.exists(path):
        return path
    stem, suffix = os.path.splitext(path)
    n = 1
    while os.path.exists(f"{stem}({n}){suffix}"):
        n += 1
    return f"{stem}({n}){suffix}"


def placed(src: str, dst: str, mode: str) -> None:
    """A copy, hard link or symbolic link of src at dst, in place of what is there; made beside it and renamed."""
    make = {"copy": shutil.copyfile, "link": os.link, "symlink": os.symlink}
    if mode not in make:
        raise ValueError(mode)
    if os.path.exists(dst) and os.path.samefile(src, dst) and not os.path.islink(dst):
        return
    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
    part = f"{dst}.{uuid.uuid4().hex}"
    make[mode](src, part)
    os.replace(part, dst)


def applied(actions: DataFrame) -> None:
    """Does the actions (src, dst, mode) from the executors; all paths are on a file system that they share."""
    def run(rows) -> None:
        for row in rows:
            placed(row["src"], row["dst"], row["mode"])

    actions.select("src", "dst", "mode").foreachPartition(run)


def paired_copies(pairs: DataFrame, target: str, mode: str) -> DataFrame:
    """Actions that put images and their pages (image, xml) into target and target/page; a page that is missing has none."""
    at = lambda c, sub: F.concat(F.lit(f"{target.rstrip('/')}/{sub}"), T.name_of(F.col(c)))
    one = lambda c, sub: F.struct(F.col(c).alias("src"), at(c, sub).alias("dst"), F.lit(mode).alias("mode"))
    return pairs.select(F.explode(F.array(one("image", ""), one("xml", "page/"))).alias("a")).select("a.*").filter("src IS NOT NULL")
