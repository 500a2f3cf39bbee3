"""Command line over a store: ``python -m coderill.cli --store FOLDER VERB ...``; lines are tab-separated."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import functions as F

from coderill.functions.bytecode import flags
from coderill.functions.similarity import ALERT_MIN, SEARCH_MIN
from coderill.operators import calibration, clusters, codes, ingest, similarity, statistics
from coderill.session import session
from coderill.sources import rpc, views
from coderill.sources.store import Store
from coderill.streaming import follow


def _address(text: str) -> str:
    if not re.fullmatch("0x[0-9a-fA-F]{40}", text):
        raise argparse.ArgumentTypeError(f"not an address: {text}")
    return text.lower()


def _share(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"not between 0 and 1: {text}")
    return value


def _count(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"not 1 or more: {text}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="coderill")
    p.add_argument("--store", required=True)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("clusters").add_argument("--n", type=int, default=20)
    verbs.add_parser("cluster").add_argument("address", type=_address)
    similar = verbs.add_parser("similar")
    similar.add_argument("address", type=_address)
    similar.add_argument("--min", type=_share, default=SEARCH_MIN)
    verbs.add_parser("risk").add_argument("--flag", choices=("selfdestruct", "mutable_delegatecall"))
    seed = verbs.add_parser("seed")
    seed.add_argument("action", choices=("add", "remove", "list", "strict", "loose", "audit"))
    seed.add_argument("address", type=_address, nargs="?")
    seed.add_argument("--label", default="")
    seed.add_argument("--fetch", action="store_true", help="read an unknown address, or a proxy's implementation, from the node")
    seed.add_argument("--node", help="URL of a node for --fetch; {key} in it stands for a key")
    seed.add_argument("--key-variable")
    recheck = verbs.add_parser("recheck")
    recheck.add_argument("--min", type=_share, default=ALERT_MIN)
    recheck.add_argument("--origin")
    calibrate = verbs.add_parser("calibrate")
    calibrate.add_argument("labels")
    calibrate.add_argument("--grid", default=",".join(map(str, calibration.GRID)))
    verbs.add_parser("report").add_argument("--out", required=True)
    for name in ("backfill", "listen"):
        verb = verbs.add_parser(name)
        verb.add_argument("--node", required=True, help="URL of a node; {key} in it stands for a key")
        verb.add_argument("--key-variable", help="variable of the environment, or of .env, that holds the key")
        verb.add_argument("--daily-budget", type=int)
        verb.add_argument("--max-calls-per-block", type=int)
        verb.add_argument("--workers", type=_count, help="calls at once of a task; 1 with a key, else 8")
        verb.add_argument("--plan", choices=("metered", "free"), help="metered: calls have prices, and codes are read at their block; free: neither. By default metered with a key")
        verb.add_argument("--step", type=_count, default=1, help="blocks of a batch")
        verb.add_argument("--alert-on", choices=("created", "seen", "all"), default="all")
        verb.add_argument("--min", type=_share, default=ALERT_MIN)
        if name == "backfill":
            verb.add_argument("--from", dest="first", type=int, required=True)
            verb.add_argument("--to", dest="last", type=int, required=True)
        else:
            verb.add_argument("--interval", type=float, default=12)
    dashboard = verbs.add_parser("dashboard")
    dashboard.add_argument("--host", default="127.0.0.1")
    dashboard.add_argument("--port", type=int, default=8080)
    dashboard.add_argument("--static")
    return p


#: Credits of a call, by method.
PRICES = {"eth_blockNumber": 80, "eth_getBlockReceipts": 1000, "eth_getCode": 80, "eth_getStorageAt": 80}


def _url(args: argparse.Namespace) -> str:
    return rpc.node_url(args.node, args.key_variable) if args.key_variable else args.node


def _follow(args: argparse.Namespace, store: Store, say) -> int:
    """Blocks of a node into the store, with the lines of each batch's events as they are committed; 3 where a limit stops it."""
    metered = args.plan == "metered" or args.plan is None and args.key_variable is not None
    if args.daily_budget is not None and not metered:
        raise ValueError("--daily-budget needs a metered plan")
    url, workers, tag = _url(args), args.workers or (1 if metered else 8), None if metered else "latest"
    limits = follow.Limits(args.max_calls_per_block, args.daily_budget, PRICES if metered else {})
    get_code, get_slot = rpc.code_fetcher(url, tag=tag, workers=workers), rpc.slot_fetcher(url, tag=tag, workers=workers)
    last = store.read("events").agg(F.max("id")).first()[0] or 0

    def told() -> None:
        nonlocal last
        fresh = store.read("events").filter(F.col("id") > last)
        for r in ingest.lines(fresh, args.alert_on).orderBy("id").toLocalIterator():
            say(r["line"])
        last = max(last, fresh.agg(F.max("id")).first()[0] or 0)

    options = {"step": args.step, "told": told, "get_slot": get_slot, "watch": args.min}
    try:
        if args.verb == "backfill":
            out = follow.backfill(store, url, args.first, args.last, get_code, limits, **options)
        else:
            out = follow.watch_chain(store, url, get_code, limits, args.interval, **options)
    except KeyboardInterrupt:
        return 0
    if out.stopped is None:
        return 0
    progress = "none" if out.progress is None else out.progress
    print(f"stopped: {out.stopped}, spent {store.spent(out.day)} credits, progress {progress}", file=sys.stderr)
    return 3


def _serve(args: argparse.Namespace, store: Store) -> int:
    from coderill import serving

    try:
        server = serving.server(store, args.host, args.port, args.static)
    except OSError as error:
        print(error, file=sys.stderr)
        return 2
    print("serving http://%s:%d/" % server.server_address[:2], file=sys.stderr)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()
    return 0


def run(args: argparse.Namespace) -> int:
    spark = session()
    store = Store(spark, args.store, readonly=args.verb not in ("backfill", "listen", "seed"))
    say = lambda *fields: print("\t".join(map(str, fields)), flush=True)
    if args.verb in ("backfill", "listen"):
        return _follow(args, store, say)
    if args.verb == "dashboard":
        return _serve(args, store)
    stored, held = store.addresses(), store.codes()
    own, seeds = codes.effective(stored, held), store.seeds()
    flagged = held.select("code_id", flags(F.col("selfdestruct"), F.col("mutable_delegatecall")).alias("flags"))
    if args.verb == "clusters":
        for r in clusters.top(views.sizes(store), args.n).collect():
            say(r["level"], r["key"], r["n_members"])
    elif args.verb == "cluster":
        mine = stored.filter(F.col("address") == args.address).join(flagged, "code_id").first()
        for r in clusters.containing(stored, held, args.address).toLocalIterator():
            say(r["level"], r["key"], ",".join(r["members"]), mine["flags"] if mine else "-")
    elif args.verb == "similar":
        found = similarity.find_similar(held, own, args.address, args.min).join(stored.join(flagged, "code_id").select("address", "flags"), "address", "left")
        for r in found.orderBy(F.desc("score"), "address").toLocalIterator():
            say(r["address"], f"{r['score']:.4f}", r["flags"] or "-")
    elif args.verb == "risk":
        for r in statistics.flagged_addresses(stored, held, args.flag).toLocalIterator():
            say(r["address"], args.flag or r["flags"])
    elif args.verb == "seed":
        return _seed(args, store, say)
    elif args.verb == "recheck":
        for r in similarity.recheck(stored, held, seeds, own, args.min, origin=args.origin).toLocalIterator():
            say("ALERT", r["address"], r["seed_address"], r["label"], f"{r['score']:.4f}", r["origin"])
    elif args.verb == "calibrate":
        labels, grid = calibration.load_labels(args.labels), calibration.parse_grid(args.grid)
        pairs, strict = calibration.label_frames(spark, labels)
        for r in calibration.missing(pairs, stored).collect():
            print(f"missing: {r['address']}", file=sys.stderr)
        for r in calibration.evaluate(pairs, strict, stored, held, grid).collect():
            say(r["threshold"], f"{r['recall']:.4f}", r["negatives"], r["benign"], r["interface_only"], r["benign_total"])
    elif args.verb == "report":
        from coderill import report

        print(*report.write(report.collect(stored, held, seeds, own, store.read("ledger")), args.out), sep="\n")
    return 0


def _seed(args: argparse.Namespace, store: Store, say) -> int:
    if args.action == "list":
        for r in store.seeds().collect():
            say(r["address"], r["label"])
        return 0
    if args.action == "audit":
        seeds = store.seeds()
        hits = similarity.interface_hits(store.codes(), seeds).join(seeds.withColumnRenamed("address", "seed_address"), "seed_address")
        for r in hits.orderBy("seed_address").collect():
            say(r["seed_address"], r["label"], r["hits"], "strict" if r["strict"] else "loose")
        return 0
    if args.address is None:
        raise ValueError("an address is needed")
    if args.action == "add":
        if args.fetch:
            if args.node is None:
                raise ValueError("--fetch needs --node")
            code = store.code_of(args.address).first()
            proxy = code is not None and code["std_proxy"] and store.implementations([args.address]).isEmpty()
            if proxy or not store.has_address(args.address):  # of what is held, nothing is asked
                url = _url(args)
                kind = follow.fetch(store, args.address, rpc.head(url), rpc.code_fetcher(url), rpc.slot_fetcher(url))
                if kind == "failed":
                    print(f"eth_getCode returned no code: {args.address}", file=sys.stderr)
                    return 1
        store.add_seed(args.address, args.label)
        stored, held = store.addresses(), store.codes()
        one = store.seeds().filter(F.col("address") == args.address)
        for r in similarity.recheck(stored, held, one, codes.effective(stored, held)).collect():
            say("ALERT", r["address"], r["seed_address"], r["label"], f"{r['score']:.4f}", r["origin"])
        return 0
    done = store.remove_seed(args.address) if args.action == "remove" else store.set_strict(args.address, args.action == "strict")
    return 0 if done else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except KeyError as error:
        print(f"unknown address or no code: {error.args[0]}", file=sys.stderr)
        return 2
    except ValueError as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return 2
    except (rpc.RpcError, PermissionError) as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
