"""Command line over the binary layouts: `python -m keyframe.cli VERB ...`."""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import FrameDataset
from .errors import FrameError
from .functions.render import FORMATS, header, line, toml
from .operators import maintain, mutate, organize, read
from .sources import datasource as ds
from .sources import facts
from .types import Schema

#: Bytes by the unit of a page-size token.
UNITS = {"B": 1, "KB": 1000, "KiB": 1024, "MB": 1_000_000, "MiB": 1 << 20}
CODEC_TOKENS, ENCODING_TOKENS = ("zstd", "lz4", "uncompressed"), ("row-raw", "columnar-basic", "columnar-delta")
PACKINGS = {"tight-fit": "tight", "estimate-shrink": "estimate"}


def page_size(token: str) -> int | None:
    m = re.fullmatch(r"(\d+)(B|KB|KiB|MB|MiB)", token)
    if not m:
        return None
    n = int(m[1]) * UNITS[m[2]]
    if not 1 << 10 <= n <= 16 << 20:
        raise FrameError(f"page size {token} is not within 1KiB..16MiB")
    return n


def write_tokens(tokens: list[str]) -> tuple[dict, list[str]]:
    """Options from tokens in any place, each kind once; the rest is returned."""
    out, rest = {}, []
    for t in tokens:
        if t == "smallest":
            found = {"codec": t, "encoding": t}
        elif t in CODEC_TOKENS or (level := re.fullmatch(r"zstd:(\d+)", t)):
            found = {"codec": t} if t in CODEC_TOKENS else {"codec": "zstd", "level": int(level[1])}
        elif t in ENCODING_TOKENS:
            found = {"encoding": t}
        elif t in PACKINGS:
            found = {"packing": PACKINGS[t]}
        elif t in ("v1", "v2"):
            found = {"version": int(t[1])}
        elif size := page_size(t):
            found = {"page_size": size}
        else:
            rest.append(t)
            continue
        if again := found.keys() & out.keys():
            raise FrameError(f"{min(again)} is given twice")
        out |= found
    return out, rest


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("keyframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


#: Facts of `ls`, by the names of file_facts and page_facts.
LS = ("path", "version", "title", "frame_type", "key_field", "field_count", "string_count", "frame_length", "frame_count", "first_key", "last_key", "file_bytes")


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The facts of `ls` for each file, and the problem of one that cannot be read."""
    files, pages = facts.file_facts(spark, paths), facts.page_facts(spark, paths)
    ends = pages.groupBy("path").agg(F.min_by("first_key", "page").alias("first_key"), F.max_by("last_key", "page").alias("last_key"))
    return files.join(ends, "path", "left").select(*LS, "problem")


def table_lines(names: list[str], rows: list[tuple], fmt: str) -> list[str]:
    """A small table as csv, jsonl, md, or in columns."""
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if fmt == "jsonl":
        return [json.dumps(dict(zip(names, r, strict=True)), ensure_ascii=False) for r in rows]
    if fmt == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue().splitlines()
    if fmt == "md":
        return ["| " + " | ".join(r) + " |" for r in [list(names), ["---"] * len(names), *[[c.replace("|", "\\|") for c in r] for r in cells]]]
    width = [max(map(len, c)) for c in zip(names, *cells, strict=True)]
    return ["  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in [list(names), *cells]]


def shown(d: FrameDataset, df: DataFrame) -> list[str]:
    """A few frames as a table; df is a preview, of six at most."""
    return [*header(d, "table"), *[r[0] for r in df.orderBy(*d.order).select(line(d, "table")).collect()]]


def paths_of(tokens: list[str]) -> tuple[list[str], list[str]]:
    """Arguments that are files or folders, and the others."""
    return [t for t in tokens if os.path.exists(t)], [t for t in tokens if not os.path.exists(t)]


def run(args: argparse.Namespace, out=None) -> int:
    spark, out = spark_session(), out or sys.stdout
    show = lambda text: print(text, file=out)
    say = lambda **facts: show(toml({"operation": {"verb": args.verb, **facts}}))
    if args.verb == "new":
        options, rest = write_tokens(args.rest)
        if args.template:
            like = ds.load(spark, args.template)
            schema, strings, title = like.schema, like.strings, args.title if args.title != "untitled" else like.title
        else:
            schema, strings, title = Schema.parse(args.type, rest[0]), (), args.title
        if os.path.exists(args.path) and not args.force:
            raise FrameError(f"{args.path} exists")
        ds.save(FrameDataset(spark.createDataFrame([], schema.spark_schema()), schema, title, strings), args.path, **options)
        return 0
    if args.verb in ("convert", "concat"):
        options, rest = write_tokens(args.rest)
        paths, target = [args.path, *rest[:-1]], rest[-1]
        if os.path.exists(target) and not args.force or os.path.abspath(target) in map(os.path.abspath, paths):
            raise FrameError(f"{target} exists")
        sets = [ds.load(spark, p) for p in paths]
        if "version" not in options and all(ds.open_file(f).version == 1 for p in paths for f in ds.discover(p)) and args.verb == "concat":
            options["version"] = 1  # only sources of version 1 stay what they are
        if any(d.schema != sets[0].schema for d in sets):
            print("warning: semantics differ; the richest are kept", file=sys.stderr)
        joined = sets[0] if len(sets) == 1 else organize.concat(sets, strict=False)
        ds.save(joined, target, **options)
        say(sources=len(paths), frame_count=joined.df.count(), output=target)
        return 0
    if args.verb == "append":
        options, sources = write_tokens(args.rest)
        options.pop("version", None)
        n = sum(ds.append(spark, args.path, ds.load(spark, p), **options) for p in sources)
        say(sources=len(sources), appended=n, frame_count=ds.load(spark, args.path).df.count())
        return 0
    if args.verb == "ls":
        more, rest = paths_of(args.rest)
        rows = [tuple(r) for r in listing(spark, [args.path, *more]).orderBy("path").collect()]  # a row for each file
        fmt = next((t for t in rest if t in ("csv", "jsonl", "md", "table")), "table")
        for text in table_lines(list(LS), [r[:-1] for r in rows if r[-1] is None], fmt):
            show(text)
        for r in rows:
            if r[-1] is not None:
                print(f"{r[0]}: {r[-1]}", file=sys.stderr)
        return int(any(r[-1] is not None for r in rows))
    if args.verb == "verify":
        check = facts.light_verify if args.light else facts.verify_files
        rows = check(spark, [args.path, *args.rest]).orderBy("path").collect()  # a row for each file
        for r in rows:
            show(f"{r.path}: {r.problem or ('sound' if args.light else f'{r.frame_count} frames')}")
        return int(any(r.problem for r in rows))
    if args.verb == "set":
        more, rest = paths_of(args.rest)
        done = dict(t.split("=", 1) for t in rest)
        title, kind = done.pop("title", None), done.pop("type", None)
        names = {k.removeprefix("rename:"): done.pop(k) for k in list(done) if k.startswith("rename:")}
        targets = [args.path, *more]
        if args.out and len(targets) > 1:
            raise FrameError("--out is for one input")
        changed = []
        for p in targets:  # all are checked before any is written
            d = ds.load(spark, p)
            d = mutate.set_title(d, title) if title else d
            d = mutate.set_frame_type(d, kind) if kind else d
            d = mutate.set_semantics(d, done) if done else d
            changed.append((p, mutate.rename(d, names) if names else d, ds.open_file(ds.discover(p)[0]).version))
        for p, d, version in changed:
            ds.save(d, args.out or p + ".new", version)
        say(inputs=len(targets), changes=len(done) + len(names) + bool(title) + bool(kind))
        return 0
    d = ds.load(spark, args.path)
    if args.verb == "inspect":
        show(toml(maintain.inspect(d)))
        for i, r in enumerate(facts.page_summary(facts.page_facts(spark, args.path)).orderBy("path").collect()):  # a row for each file
            show(toml({f"pages.{i}": {k: v for k, v in r.asDict().items() if v is not None}}))
        for text in shown(d, read.preview(d)):
            show(text)
    elif args.verb == "find":
        found = read.find(d, args.rest)
        show(toml({"selection": {k: v for k, v in found.items() if k != "ranges"}}))
        picked = read.select(d, args.rest)
        for text in shown(d, read.preview(d.of(picked))):
            show(text)
    elif args.verb == "cat":
        fmt = next((t for t in args.rest if t in FORMATS), "raw")
        for h in header(d, fmt):
            show(h)
        chosen = read.select(d, [t for t in args.rest if t not in FORMATS])
        for r in chosen.orderBy(*d.order).select(line(d, fmt)).toLocalIterator():
            show(r[0])
    elif args.verb == "rm":
        kept, n = mutate.remove(d, args.rest, confirm=args.yes)
        ds.save(kept, args.out or args.path + ".new", version=ds.open_file(ds.discover(args.path)[0]).version)
        say(removed=n)
    elif args.verb == "split":
        from .functions.keys import parse_key

        for i, p in enumerate(organize.parts(d, [parse_key(d.schema.key, k) for k in args.rest], args.keep_empty)):
            ds.save(p, f"{args.path}.part{i}")
    elif args.verb == "bench":
        for text in table_lines(list(BENCH), bench(spark, d, args.path + ".bench", args.iterations), "table"):
            show(text)
    return 0


BENCH = ("codec", "encoding", "bytes", "ratio", "convert_ms", "scan_ms", "range_ms", "random_ms")


def bench(spark: SparkSession, d: FrameDataset, folder: str, iterations: int) -> list[tuple]:
    """Every codec with every encoding: bytes, and times to write, to scan, to read a range in the middle and a frame; by size, then time."""
    n = d.df.count()
    logical, out = n * d.schema.frame_length, []

    def timed(f) -> float:
        t = time.perf_counter()
        for _ in range(iterations):
            f()
        return round((time.perf_counter() - t) * 1000 / iterations, 1)

    for c in CODEC_TOKENS:
        for e in ENCODING_TOKENS:
            path = f"{folder}/{c}-{e}"
            t = time.perf_counter()
            ds.save(d, path, 2, codec=c, encoding=e)
            convert = round((time.perf_counter() - t) * 1000, 1)
            made = ds.load(spark, path)
            size = facts.page_summary(facts.page_facts(spark, path)).agg(F.sum("stored_bytes")).first()[0] or 0
            scan = timed(lambda made=made: made.df.write.format("noop").mode("overwrite").save())
            middle = timed(lambda made=made: read.frames_slice(made, n // 4, 3 * n // 4).write.format("noop").mode("overwrite").save())
            one = timed(lambda made=made: read.frame_at(made, n // 2).collect())
            out.append((c, e, size, round(size / logical, 3) if logical else None, convert, scan, middle, one))
    return sorted(out, key=lambda r: (r[2], r[4]))


VERBS = ("new", "inspect", "verify", "ls", "bench", "convert", "append", "split", "concat", "set", "find", "cat", "rm")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="keyframe", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("path")
    p.add_argument("rest", nargs="*")
    p.add_argument("--title", default="untitled")
    p.add_argument("--type", default="Frame")
    p.add_argument("--template", help="a file or folder whose schema and strings a new one takes")
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--light", action="store_true")
    p.add_argument("--out")
    p.add_argument("--yes", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--keep-empty", action="store_true")
    try:
        return run(p.parse_intermixed_args(argv))
    except FrameError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
