"""Command line over a folder of books: analyze, repair, validate, map-css, map-structure and init-config."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textmend")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("path", help="folder of books")
        c.add_argument("--config", help="TOML file of settings")
        c.add_argument("--no-container-repair", action="store_true", help="report broken containers, don't repair them")
        return c

    c = add("analyze", "tables of what is in the books and what is wrong with them")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--details", action="store_true", help="list every issue, not only their numbers by category")
    c.add_argument("--json", action="store_true", help="also write each table as JSON, and reuse a report that is there")
    c = add("repair", "repaired books")
    c.add_argument("-o", "--output")
    c.add_argument("--dry-run", action="store_true", help="only say what would be done")
    c.add_argument("--class-mapping", help="TOML mapping of classes; written for review if it isn't there")
    c.add_argument("--verbose", action="store_true")
    c = add("validate", "checks of the containers")
    c.add_argument("--repair", action="store_true", help="also say whether each one can be repaired")
    c.add_argument("-o", "--output", help="write the checks as a table")
    add("map-css", "what each class seems to be for").add_argument("--write-mapping", help="write an editable mapping")
    add("map-structure", "the chapters and how sure each boundary is")
    sub.add_parser("init-config", help="write the default settings").add_argument("-o", "--output", default="textmend.toml")
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    from textmend.sources import config

    if a.command == "init-config":
        config.write_default(a.output)
        return 0
    settings = config.load(a.config)
    if a.no_container_repair:
        settings = replace(settings, repair_containers=False)
    if a.command == "repair" and not (a.output or a.dry_run):
        print("repair needs --output or --dry-run", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("textmend").getOrCreate()
    from textmend.plans import runtime

    try:
        return {"analyze": analyze, "repair": repair, "validate": validate, "map-css": map_css, "map-structure": map_structure}[a.command](spark, a, settings)
    finally:
        runtime.clean(spark)


def analyze(spark, a, settings) -> int:
    from pyspark.sql import functions as F

    from textmend.plans import corpus

    report = f"{a.output}/json"
    if a.json and os.path.isdir(report):
        spark.read.json(f"{report}/summary").orderBy("table").show(100, truncate=False)
        return 0
    tables = corpus.analyze_corpus(spark, a.path, settings)
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")
        done = spark.read.parquet(f"{a.output}/{name}")
        counts.append((name, done.count()))
        if a.json:
            done.write.mode("overwrite").json(f"{report}/{name}")
    if a.json:
        spark.createDataFrame(counts, "table string, rows long").coalesce(1).write.mode("overwrite").json(f"{report}/summary")
    issues = spark.read.parquet(f"{a.output}/issues")
    if a.details:
        for r in issues.orderBy("book", "name", "slot_no").toLocalIterator():
            print(f"{r['book']} {r['name']} {r['slot_no']}: {r['before']!r} -> {r['after']!r}")
    else:
        issues.groupBy("book").agg(F.count("*").alias("issues"), F.countDistinct("name").alias("pages")).orderBy(F.desc("issues"), "book").show(truncate=False)
    for r in spark.read.parquet(f"{a.output}/covers").where("problem").toLocalIterator():
        print(f"{r['book']}: {r['status']}")
    return 0


def repair(spark, a, settings) -> int:
    from textmend.plans import corpus
    from textmend.sources import config

    mapping = None
    if a.class_mapping:
        if not os.path.exists(a.class_mapping):
            # nothing is applied that nobody has looked at
            write_mapping(spark, a, settings, a.class_mapping)
            print(f"wrote {a.class_mapping}; check it and run again")
            return 0
        mapping = config.load_mapping(a.class_mapping)
    if a.dry_run or a.verbose:
        report = corpus.repair_report(spark, a.path, settings, mapping)
        if a.verbose:
            for r in report.orderBy("book", "location", "category").toLocalIterator():
                print(f"{r['book']} {r['location']}: {r['category']}: {r['n']}")
        else:
            report.groupBy("category").sum("n").orderBy("category").show(truncate=False)
    if not a.dry_run:
        corpus.repair_corpus(spark, a.path, settings, mapping).write.mode("overwrite").parquet(a.output)
    return 0


def validate(spark, a, settings) -> int:
    from textmend.sources import epub

    checked = epub.archives(spark, a.path, repair=a.repair)
    rows = checked.select("book", "valid", "failed", "actions", checked["content"].isNotNull().alias("usable"))
    if a.output:
        rows.write.mode("overwrite").parquet(a.output)
        rows = spark.read.parquet(a.output)
    bad = 0
    for r in rows.orderBy("book").toLocalIterator():
        ok = r["valid"] or a.repair and r["usable"]
        bad += not ok
        print(f"{r['book']}: " + ("valid" if r["valid"] else f"failed: {r['failed']}" + (f"; {', '.join(r['actions'])}; {'repaired' if r['usable'] else 'not repaired'}" if a.repair else "")))
    return int(bad > 0)


def profiles(spark, a, settings):
    from textmend.plans import corpus

    return corpus.class_profiles(corpus.Corpus(spark, a.path, settings))


def write_mapping(spark, a, settings, path: str) -> None:
    """One mapping for the folder: each class as the book that uses it most has it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from textmend.operators import classes

    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("usage"), "book_id"))
    most = profiles(spark, a, settings).withColumn("rank", rank).where("rank = 1").drop("rank")
    with open(path, "x", encoding="utf-8") as f:
        f.write(classes.mapping_file(most))


def map_css(spark, a, settings) -> int:
    from pyspark.sql import functions as F

    from textmend.operators import classes

    for r in classes.map_line(profiles(spark, a, settings)).orderBy("book_id", F.desc("usage"), "class").toLocalIterator():
        print(f"{r['book_id']} {r['line']}")
    if a.write_mapping:
        write_mapping(spark, a, settings, a.write_mapping)
    return 0


def map_structure(spark, a, settings) -> int:
    from textmend.plans import corpus
    from textmend.plans.runtime import stage

    rows = stage(corpus.structure_of(corpus.Corpus(spark, a.path, settings)), "structure")
    for b in rows.select("book").distinct().orderBy("book").toLocalIterator():
        print(b["book"], *corpus.structure_report(rows.where(rows["book"] == b["book"])), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
