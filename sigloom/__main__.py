"""``python -m sigloom MODE [-key value ...]``: settings come from config.txt, if it is there, and then from the command line."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from sigloom import engine
from sigloom.config import EngineConfig
from sigloom.sources import results


def main(args: list[str]) -> int:
    if not args or args[0] not in [*engine.MODES, "experimental-rf"]:
        print(f"usage: python -m sigloom MODE [-key value ...]\nmodes: {', '.join([*engine.MODES, 'experimental-rf'])}", file=sys.stderr)
        return 2
    config = EngineConfig()
    if os.path.exists("config.txt"):
        config = config.with_file("config.txt")
    config = config.with_arguments(args[1:])
    spark = SparkSession.builder.appName("sigloom").getOrCreate()
    fmt = config.get("RESULTS-FORMAT", results.DEFAULT)
    if args[0] == "experimental-rf":
        session(spark, config, fmt)
        return 0
    found = engine.run(spark, args[0], config)
    if args[0] in engine.PRINTED and not config.get("RESULTS-PATH"):
        for row in results.lines(found.orderBy("topic_id", "rank"), fmt).toLocalIterator():
            print(row["value"])
    elif args[0] == "histogram":
        documents = "doc_id" in found.columns
        bins = found.where("doc_id IS NULL") if documents else found
        for row in bins.orderBy("hd").toLocalIterator():
            print(f"{row['fraction']:.32f}")
        for row in found.where("doc_id IS NOT NULL").orderBy("hd", "doc_id").toLocalIterator() if documents else ():
            print(f"{row['doc_id']} {row['hd']} {row['fraction']:.32f}")
    return 0


def session(spark: SparkSession, config: EngineConfig, fmt: str) -> None:
    """Topics from standard input as lines ``id text``; for each the best document is printed, then a number of feedback lines is read."""

    def asked():  # noqa: ANN202
        for line in sys.stdin:
            topic, _, text = line.rstrip("\n").partition(" ")
            yield topic, text

    def told(topic: str, best: str) -> list[str]:
        print(best, flush=True)
        return [sys.stdin.readline().rstrip("\n") for _ in range(int(sys.stdin.readline() or 0))]

    for topic, rows in engine.feedback_session(spark, config, asked(), told):
        for r in rows:
            print(f"{topic} Q0 {r['doc_id']} {r['rank']} {1_000_001 - r['rank']} {results.RUN_NAME} {r['dist']}", flush=True)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
