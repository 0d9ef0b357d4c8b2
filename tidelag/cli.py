"""Command line: spark-submit this file, or python -m tidelag.cli, with a sub-command."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from tidelag import api
from tidelag.sources import tables

COMMANDS = {
    "embed": api.Embedding, "simplex": api.Simplex, "smap": api.SMap, "ccm": api.CCM, "multiview": api.Multiview,
    "embed-dimension": api.EmbedDimension, "predict-interval": api.PredictInterval, "predict-exclusion-radius": api.PredictExclusionRadius,
    "predict-nonlinear": api.PredictNonlinear, "surrogate": api.SurrogateData, "ccm-matrix": api.CCM_Matrix, "crossmap-matrix": api.CrossMap_Matrix,
    "crossmap-columns": api.CrossMap_Columns, "crossmap-column-list": api.CrossMap_ColumnList, "embed-dim-columns": api.EmbedDim_Columns,
    "smap-theta": api.SMap_theta, "smap-tp": api.SMap_Tp,
}
#: Arguments that are lists whatever their default.
#: Commands that take a dimension for each column: one number, several, or a table of (column, E).
EACH_E = {"ccm-matrix", "crossmap-matrix", "crossmap-columns"}
LISTS = {"lib", "pred", "libSizes", "pLibSizes", "theta_list", "thetaList", "TpList", "order", "Evec"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        p.add_argument("-i", "--input", required=True, help="table: .csv, .parquet, .feather, .orc or .json")
        p.add_argument("-o", "--output", required=True, help="result, by the same endings")
        p.add_argument("--part", help="which table of a result that has several")
        for a in list(inspect.signature(f).parameters.values())[1:]:
            if a.kind is a.VAR_KEYWORD or a.name in ("outputFile", "spark", "dataFile", "pathIn"):
                continue
            default = None if a.default is a.empty else a.default
            if a.name == "E" and name in EACH_E:
                p.add_argument("--E", type=str, default=str(default), help="a number, one for each column, or a table with the columns column and E")
                continue
            kind = str if default is None or default == "" or a.name in LISTS or isinstance(default, tuple) else type(default)
            if kind is bool:
                p.add_argument(f"--{a.name}", action=argparse.BooleanOptionalAction, default=default)
            else:
                p.add_argument(f"--{a.name}", type=kind, default=default, required=a.default is a.empty)
    return top


def dimensions(spark: SparkSession, e: str, df, args: dict):
    """E as a number, or as one for each of the columns."""
    if all(x.isdigit() for x in e.replace(",", " ").split()):
        es = [int(x) for x in e.replace(",", " ").split()]
        return es[0] if len(es) == 1 else es
    known = args.get("columns")
    known = known.split() if isinstance(known, str) and known else known
    columns = known or [c for c in df.columns[0 if args.get("noTime") else 1 :] if c != args.get("series") and c not in (args.get("order") or ())]
    args["columns"] = columns
    return tables.dimensions(tables.read(spark, e), columns)


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    f = COMMANDS[command]
    source, to, part = args.pop("input"), args.pop("output"), args.pop("part")
    spark = SparkSession.builder.appName("tidelag").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for k, v in args.items():
        if isinstance(v, str) and k in LISTS:
            args[k] = v.split() if k == "order" else [float(x) if "." in x else int(x) for x in v.replace(",", " ").split()]
    if isinstance(args.get("seed"), str):
        args["seed"] = int(args["seed"])
    if isinstance(args.get("alpha"), str):
        args["alpha"] = float(args["alpha"])
    if isinstance(args.get("threshold"), str):
        args["threshold"] = float(args["threshold"])
    if isinstance(args.get("exclusionRadius"), str):
        args["exclusionRadius"] = [int(x) for x in args["exclusionRadius"].split()]
    if f is api.PredictNonlinear and isinstance(args.get("theta"), str):
        args["theta"] = [float(x) for x in args["theta"].split()]
    if f is api.CrossMap_ColumnList:
        args["columns"] = [c.split("+") for c in args["columns"].split()]
    df = tables.read(spark, source)
    if command in EACH_E:
        args["E"] = dimensions(spark, args["E"], df, args)
    out = f(df, **args)
    if isinstance(out, dict):
        out = out[part or next(iter(out))]
    tables.write(out, to)


if __name__ == "__main__":
    main()
