"""``python -m manifolder.cli --source parquet --path points.parquet --out layout.parquet``"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from manifolder.plans.estimator import GraphLayout
from manifolder.plans.params import PRESETS, Params
from manifolder.sources.loaders import SOURCES, get_dataset
from manifolder.sources.runs import plot_points


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--source", choices=sorted(SOURCES), default="swiss_roll")
    p.add_argument("--path", help="what the source reads; a number of points for generators")
    p.add_argument("--labels", help="second file of a source that has one")
    p.add_argument("--num-points", type=int)
    p.add_argument("--desired-dim", type=int, default=-1)
    p.add_argument("--no-normalize", action="store_true", help="keep values as they are")
    p.add_argument("--preset", choices=sorted(PRESETS))
    p.add_argument("--out", help="Parquet folder for (id, px, py, label)")
    for name in ("n-neighbors", "dim", "n-epochs", "seed"):
        p.add_argument(f"--{name}", type=int)
    for name in ("learning-rate", "neg-sample-rate", "spread", "min-dist", "a", "b"):
        p.add_argument(f"--{name}", type=float)
    for name in ("random-init", "pseudo-distance", "tsne-symmetrization", "normalized", "sym-attraction", "frobenius", "amplify-grads", "angular", "accelerated"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--method", choices=["blended", "umap", "tsne"])
    p.add_argument("--metric", choices=["euclidean", "cosine"])
    return p.parse_args(argv)


def params_of(args: argparse.Namespace) -> Params:
    base = PRESETS[args.preset] if args.preset else Params(pseudo_distance=False, sym_attraction=False, neg_sample_rate=1)
    given = {k: v for k, v in vars(args).items() if v is not None and k in Params.__dataclass_fields__}
    if given.get("n_epochs", 1) < 0:
        given.pop("n_epochs")
    if "normalized" in given and "amplify_grads" not in given:
        given["amplify_grads"] = given["normalized"]
    return base.with_(**given)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("manifolder").getOrCreate()
    inputs = [int(args.path) if args.path and args.path.isdigit() else args.path] if args.path else []
    if args.source == "swiss_roll" and not inputs:
        inputs = [1000]
    inputs += [args.labels] if args.labels else []
    points = get_dataset(spark, args.source, *inputs, num_points=args.num_points, normalize=not args.no_normalize, desired_dim=args.desired_dim)
    layout = GraphLayout(params_of(args))
    began = time.time()
    placed = layout.fit_transform(points.select("id", "x")).join(points.select("id", "label"), "id")
    print(f"{placed.count()} points in {time.time() - began:.1f} s, epochs in {layout.opt_time:.1f} s")
    if args.out:
        plot_points(placed).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
