"""``python -m specloom list-models | list-ops | smoke | transfer --slave A --master B``."""

from __future__ import annotations

import argparse
import sys

import numpy as np


def smoke() -> int:
    """Trains, scores and monitors a synthetic mixture; 0 if all figures are as they should be."""
    from pyspark.sql import SparkSession

    from .operators import mspc
    from .plans import serve, train

    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    rng, axis = np.random.default_rng(0), np.linspace(200, 700, 101)
    shapes = np.stack([np.exp(-0.5 * ((axis - a) / w) ** 2) for a, w in ((260, 20), (340, 30), (520, 40))])
    c = rng.uniform(size=(120, 3)) * [1, 0.5, 0.3]
    x, y = c @ shapes + rng.normal(0, 1e-3, (120, 101)), 2 * c[:, 0] + 0.1
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "sample_id long, x array<double>, y double")
    card = train.train_model(df, list(axis), "AN", "pls", [{"op": "savgol"}], {"n_components": 5})
    gap = serve.EdgeModel.compile(card).verify(card, x)
    shifted = spark.createDataFrame([(0, (x[0] + 0.05).tolist())], "sample_id long, x array<double>")
    row = mspc.fit(df.select("sample_id", "x"), 3).monitor(shifted).first()
    print(f"rmse_cv {card.fom['rmse_cv']:.4f}  rmse_fit {card.fom['rmse_fit']:.4f}  train/serve gap {gap:.2e}  SPE {row.spe:.4f} (limit {row.spe_limit:.4f})")
    spark.stop()
    return 0 if card.fom["rmse_cv"] < 0.05 * y.std() and gap < 1e-8 and row.spe_alarm else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="specloom")
    sub = parser.add_subparsers(dest="command", required=True)
    models = sub.add_parser("list-models")
    models.add_argument("--family")
    ops = sub.add_parser("list-ops")
    ops.add_argument("--family")
    sub.add_parser("smoke")
    move = sub.add_parser("transfer")
    move.add_argument("--slave", required=True, help="instrument profile (YAML)")
    move.add_argument("--master", help="instrument profile (YAML)")
    args = parser.parse_args(argv)
    if args.command == "list-models":
        from .operators.zoo import MODELS

        for key in MODELS.keys(**({"family": args.family} if args.family else {})):
            print(key, MODELS.meta(key)["family"])
    elif args.command == "list-ops":
        from .operators.preprocess import SPECS, list_ops

        for name in list_ops(args.family):
            print(name, SPECS[name].family)
    elif args.command == "smoke":
        return smoke()
    else:
        from .sources.tables import load_instrument

        for path in filter(None, (args.slave, args.master)):
            print(load_instrument(path))
    return 0


if __name__ == "__main__":
    sys.exit(main())
