"""Commands: check-config, build, catalog, manifest, check, verbalize."""

from __future__ import annotations

import argparse
import json
import sys

from quadrille.functions.errors import QueryError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quadrille")
    sub = out.add_subparsers(dest="command", required=True)
    own = sub.add_parser("check-config", help="say what is wrong with a build's configuration")
    own.add_argument("config")
    own = sub.add_parser("build", help="publish a bundle from N-Triples or N-Quads")
    own.add_argument("config")
    own.add_argument("--dry-run", action="store_true")
    own = sub.add_parser("catalog", help="list the bundles below a folder")
    own.add_argument("root")
    for name, text in (("manifest", "print a bundle's manifest"), ("check", "hold a bundle's tables against its manifest and its statistics against its triples")):
        sub.add_parser(name, help=text).add_argument("bundle")
    own = sub.add_parser("verbalize", help="write the texts of a class as JSON lines, and its roots beside them")
    own.add_argument("bundle")
    own.add_argument("cls")
    own.add_argument("output")
    return out


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    from quadrille.sources import build, bundle

    if args.command in ("check-config", "build"):
        with open(args.config, encoding="utf-8") as f:
            text = f.read()
        wrong = build.check_config(text)
        if wrong or args.command == "check-config":
            print("\n".join(wrong) or "ok")
            return int(bool(wrong))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    try:
        if args.command == "build":
            print("\n".join(build.build(spark, build.BuildConfig.of(json.loads(text)), args.dry_run)))
        elif args.command == "catalog":
            for r in bundle.catalog(spark, args.root).collect():  # a row for each bundle
                print("\t".join(r))
        elif args.command == "manifest":
            print(bundle.manifest(spark, args.bundle).to_json())
        elif args.command == "check":
            wrong = bundle.check(spark, args.bundle) + [str(r) for r in bundle.described(spark, args.bundle).limit(20).collect()]
            print("\n".join(wrong) or "ok")
            return int(bool(wrong))
        else:
            from quadrille.operators import verbalize

            config = verbalize.Config({"all": verbalize.Target(args.cls)})
            roots, texts = verbalize.outputs(verbalize.verbalize(bundle.open_bundle(spark, args.bundle), config, "all"))
            roots.write.json(f"{args.output}/roots")
            texts.write.json(f"{args.output}/texts")
    except QueryError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
