"""``python -m bytelode PATH``: analyse the files below a path and print what was found."""

from __future__ import annotations

import argparse
import logging
import sys

from bytelode import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelode", description=__doc__)
    p.add_argument("path", nargs="?")
    p.add_argument("-e", "--work", help="folder for the tables, shared by driver and executors; spark.checkpoint.dir if it is set")
    p.add_argument("-d", "--depth", type=int, default=10)
    p.add_argument("-n", "--randomness-depth", type=int, default=1)
    p.add_argument("-P", "--plugins-path")
    p.add_argument("-S", "--skip-magic", action="append", default=[], help="start of a kind's name, besides the usual ones")
    p.add_argument("--clear-skip-magics", action="store_true")
    p.add_argument("--skip-extension", action="append", default=[".rlib"])
    p.add_argument("-s", "--skip-extraction", action="store_true")
    p.add_argument("--report", help="folder for the reports as JSON")
    p.add_argument("-f", "--force", action="store_true", help="replace reports that are there")
    p.add_argument("--extract-dir", help="also write carved chunks and entries as files there")
    p.add_argument("--delete-extracted-files", action="append", default=[], metavar="FORMAT", help="containers of a format, or of all, that aren't kept as files once they are unpacked")
    p.add_argument("--keep-extracted-chunks", action="store_true", help="write carved chunks that were unpacked, too")
    p.add_argument("--commands", action="store_true", help="let other programs unpack what isn't unpacked here")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version="bytelode 0.2")
    p.add_argument("--show-external-dependencies", action="store_true")
    p.add_argument("--build-handlers-doc", action="store_true")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from bytelode import plugins
    from bytelode.operators import multifile
    from bytelode.plans import recursion, reports
    from bytelode.sources import files, sinks

    options = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("bytelode").getOrCreate()
    ship(spark)
    if options.show_external_dependencies:
        reports.tools(spark).show(1000, truncate=False)
        return 0
    if options.build_handlers_doc:
        reports.formats_table(spark).show(1000, truncate=False)
        return 0
    if not options.path:
        parser().error("a path is needed")
    kinds = tuple([*(() if options.clear_skip_magics else files.SKIPPED_KINDS), *options.skip_magic])
    if options.verbose:
        logging.basicConfig(level=logging.INFO)
    work = options.work or spark.conf.get("spark.checkpoint.dir", None)
    if not work:
        parser().error("--work or spark.checkpoint.dir must name a folder")
    extra = (*plugins.installed(), *(plugins.load(options.plugins_path) if options.plugins_path else ()))
    parts = tuple(x for x in extra if isinstance(x, multifile.Parts))
    delete = "all" if "all" in options.delete_extracted_files else tuple(options.delete_extracted_files)
    config = recursion.Config(max_depth=options.depth, randomness_depth=options.randomness_depth, skip_kinds=kinds, skip_suffixes=tuple(options.skip_extension), skip_extraction=options.skip_extraction, formats=tuple(x for x in extra if not isinstance(x, multifile.Parts)), kinds=(*multifile.KINDS, *parts), delete=delete, commands=options.commands)
    read = files.read_files(spark, options.path)
    made = recursion.analyse(read, work, config)
    rows = reports.of_analysis(made)
    if options.report:
        reports.to_json(rows).select("json").write.mode("overwrite" if options.force else "errorifexists").text(options.report)
    if options.extract_dir:
        carved = made.chunks.filter("depth = 0")
        if not options.keep_extracted_chunks:
            # What was unpacked without an error is in its entries.
            done = made.entries.groupBy(F.col("parent_id").alias("chunk_id")).agg(F.max((F.col("severity") == "ERROR").cast("int")).alias("bad")).filter("coalesce(bad, 0) = 0").select("chunk_id")
            carved = carved.join(done, "chunk_id", "left_anti")
        sinks.write_files(sinks.carved(carved, read), options.extract_dir, options.force)
        entries = made.entries.filter("type = 'file' AND content IS NOT NULL").select(F.concat_ws("/", "parent_id", "path").alias("path"), "content")
        entries = entries.join(made.deleted.select("path"), "path", "left_anti")
        sinks.write_files(entries, options.extract_dir, options.force)
    reports.size_summary(files.stat(made.tasks)).show()
    unknown = made.gaps.filter("kind = 'unknown'").select(F.lit("unknown").alias("handler"), (F.col("end") - F.col("start")).alias("size"))
    sizes = made.chunks.select("handler", (F.col("end") - F.col("start")).alias("size")).unionByName(unknown)
    reports.ranked(reports.distribution(sizes)).show(1000, truncate=False)
    problems = made.entries.filter(F.col("severity").isNotNull()).select("parent_id", "handler", "path", "problem", "severity")
    problems.show(100, truncate=False)
    return reports.exit_code(reports.errors(rows)).first().exit_code


if __name__ == "__main__":
    sys.exit(main())
