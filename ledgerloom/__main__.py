"""Command line: load deliveries, publish the models, keep history, check, follow changes, read the mart.

    python -m ledgerloom build --out DIR [--contracts FILE.csv] [--register FILE.xml|.zip] [--seeds FILE.csv] [--mode delta]
                               [--skip-load] [--skip-register] [--skip-models] [--skip-checks] [--full-refresh] [--target prod|ci]
    python -m ledgerloom sync --out DIR [--every "60 minutes"]
    python -m ledgerloom show --out DIR --role analyst MODEL
    python -m ledgerloom lineage [--check FILE]

A build ends with 1 if there are no contracts or a check of severity error finds rows.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.access import Facade, Role
from ledgerloom.operators.merge import load, since_watermark
from ledgerloom.operators.scd2 import advance
from ledgerloom.plans import checks, mart
from ledgerloom.plans.registry import Models
from ledgerloom.session import build_session, clear_work, materialize
from ledgerloom.sources.files import CONTRACT_COLUMNS, read_contracts_csv, read_register_xml, read_seed, verify_count
from ledgerloom.sources.store import SnapshotStore
from ledgerloom.streaming import cdc

BUSINESS = [c for c in CONTRACT_COLUMNS if c != "cnid"]
SOURCES = {
    "raw_contract_data": ", ".join(f"{c} string" for c in CONTRACT_COLUMNS) + ", _loaded_at timestamp_ntz, _source_file string",
    "raw_abr_entity": "abn string, abn_status string, abn_status_from_date string, entity_type_ind string, entity_type_text string, entity_name string, name_type string, state string, postcode string, _loaded_at timestamp_ntz, _source_file string",
    "known_non_suppliers": "normalized_name string, category string, reason string",
}
HISTORY = ("supplier_key", "supplier_name", "supplier_abn", "abr_entity_name", "abr_entity_type", "abr_abn_status", "supplier_abn_is_placeholder")


def _bronze(spark: SparkSession, out: str, name: str) -> SnapshotStore:
    return SnapshotStore(spark, f"{out}/bronze/{name}")


def load_contracts(spark: SparkSession, out: str, path: str, mode: str) -> bool:
    """Load a delivery and log its changes; False where nothing in it is new.

    The log of a load is written aside and moved to where streams look for it once the load is live; a move that a
    failure kept from happening is made up for by the next load.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    store = _bronze(spark, out, "raw_contract_data")
    _move_logs(spark, out, store.version)
    parsed = read_contracts_csv(spark, path, now)
    scratch = materialize(parsed, "scratch")
    total = verify_count(scratch, parsed.count())
    old = store.read() if store.exists() else None
    if mode == "incremental" and old is not None:
        kept = since_watermark(scratch, old, "publishdate").count()
        print(f"{kept} of {total} notices are at or after the watermark")
        if not kept:
            return False
    rows = load(old, scratch, mode, "cnid", BUSINESS, "_loaded_at", now, carry=["_source_file"], actions=True)
    rows = materialize(rows, "loaded")
    before, number = old if old is not None else scratch.limit(0), store.version + 1
    cdc.change_log(before, rows, "cnid", number).write.mode("overwrite").parquet(f"{out}/bronze/_changes/load={number}")
    store.commit(rows.where("_action <> 'delete'").drop("_action"), after=number - 1)
    _move_logs(spark, out, number)
    return True


def _move_logs(spark: SparkSession, out: str, live: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{out}/bronze/_changes")
    for found in fs.listStatus(aside) if fs.exists(aside) else []:
        if int(found.getPath().getName().split("=")[1]) <= live:
            fs.mkdirs(path(f"{out}/bronze/changes"))
            fs.rename(found.getPath(), path(f"{out}/bronze/changes/{found.getPath().getName()}"))


def _sources(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    stores = {n: _bronze(spark, out, n) for n in SOURCES}
    return {n: s.read() if s.exists() else spark.createDataFrame([], SOURCES[n]) for n, s in stores.items()}


def _history(spark: SparkSession, out: str) -> SnapshotStore:
    return SnapshotStore(spark, f"{out}/gold/supplier_history", ["supplier_key"])


def build(args: argparse.Namespace) -> int:
    spark = build_session()
    try:
        return _build(spark, args)
    finally:
        clear_work(spark)


def _build(spark: SparkSession, args: argparse.Namespace) -> int:
    now = F.current_timestamp().cast("timestamp_ntz")
    if args.contracts and not args.skip_load and not load_contracts(spark, args.out, args.contracts, args.mode):
        print("nothing new")
        return 0
    if args.register and not args.skip_register:
        rows = materialize(read_register_xml(spark, args.register, now), "register")
        if rows.isEmpty():
            print("the register file holds no record; the one that is live stays", file=sys.stderr)
            return 1
        _bronze(spark, args.out, "raw_abr_entity").commit(rows)
    if args.seeds:
        _bronze(spark, args.out, "known_non_suppliers").commit(read_seed(spark, args.seeds))
    if args.skip_models:
        return 0
    if not _bronze(spark, args.out, "raw_contract_data").exists():
        print("no contracts are loaded", file=sys.stderr)
        return 1
    models = Models(spark, _sources(spark, args.out), path=args.out, target=args.target)
    for name in models.run(full_refresh=args.full_refresh):
        print(name)
    history = _history(spark, args.out)
    old = history.read() if history.exists() else None
    history.commit(materialize(advance(old, models.build("dim_supplier").select(*HISTORY), "supplier_key", HISTORY[3:], now), "history"))
    if args.skip_checks:
        return 0
    given = lambda name: mart.rpt_supplier_history(history.read()) if name == "rpt_supplier_history" else models.build(name)
    found = checks.report(given).where("n > 0").orderBy("check", "model", "column").collect()  # a line a declared check at most
    for r in found:
        print(f"{r.status}: {r.check} {r.model}.{r.column}: {r.n}")
    return int(any(r.status == "error" for r in found))


def sync(args: argparse.Namespace) -> int:
    """Merge the logged changes into the typed mirror: what is there now, or again and again."""
    spark = build_session()
    store = SnapshotStore(spark, f"{args.out}/silver/contract_mirror", ["contract_id"])
    if not store.exists():
        store.commit(cdc.mirror(spark.createDataFrame([], SOURCES["raw_contract_data"])).withColumn("_merged_at", F.lit(None).cast("timestamp_ntz")))
    trigger = {"processingTime": args.every} if args.every else {"availableNow": True}
    cdc.start_merge(spark, f"{args.out}/bronze/changes", store, f"{args.out}/bronze/_follow", F.current_timestamp().cast("timestamp_ntz"), **trigger).awaitTermination()
    print(store.read().count())
    return 0


def show(args: argparse.Namespace) -> int:
    spark = build_session()
    models = Models(spark, _sources(spark, args.out), path=args.out, target=args.target).published()
    try:
        Facade(models, {Role(r) for r in args.role}).table(args.model).show(args.rows, truncate=False)
    except PermissionError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def lineage(args: argparse.Namespace) -> int:
    if args.check:
        with open(args.check, encoding="utf-8") as f:
            return 0 if Models.declared().check_lineage(f.read()) else 1
    print(Models.declared().mermaid())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("--contracts")
    b.add_argument("--register")
    b.add_argument("--seeds")
    b.add_argument("--mode", choices=("full", "delta", "incremental"), default="delta")
    b.add_argument("--full-refresh", action="store_true")
    for what in ("load", "register", "models", "checks"):
        b.add_argument(f"--skip-{what}", action="store_true")
    b.set_defaults(run=build)
    y = commands.add_parser("sync")
    y.add_argument("--every")
    y.set_defaults(run=sync)
    s = commands.add_parser("show")
    s.add_argument("model")
    s.add_argument("--role", action="append", choices=[r.value for r in Role], required=True)
    s.add_argument("--rows", type=int, default=20)
    s.set_defaults(run=show)
    for p in (b, y, s):
        p.add_argument("--out", required=True)
        p.add_argument("--target", choices=("prod", "ci"), default="prod")
    n = commands.add_parser("lineage")
    n.add_argument("--check")
    n.set_defaults(run=lineage)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
