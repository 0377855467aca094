"""Two jobs from one configuration: topography (attributes and statistics of a surface) and accuracy (alignment to a reference
and what is left between them). Outputs are tables; maps and reports are drawn from them elsewhere."""

from __future__ import annotations

import argparse
import copy
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.api import Raster
from talus.grid import KEY, Grid
from talus.grid import downsample as thin
from talus.operators import align, biascorr, masks, stats, terrain, vertical
from talus.sources import files, outlines

METHODS = {
    "VerticalShift": align.VerticalShift,
    "NuthKaab": align.NuthKaab,
    "DhMinimize": align.DhMinimize,
    "LZD": align.LZD,
    "ICP": align.ICP,
    "CPD": align.CPD,
    "DirectionalBias": biascorr.DirectionalBias,
    "TerrainBias": biascorr.TerrainBias,
    "Deramp": biascorr.Deramp,
}
SOURCE = {"path_to_elev": None, "path_to_mask": None, "force_source_nodata": None, "from_vcrs": None, "to_vcrs": None, "downsample": 1}
OUTPUTS = {"path": "outputs", "level": 1}
TOPO = {
    "inputs": {"reference_elev": SOURCE},
    "geoids": None,
    "outputs": OUTPUTS,
    "statistics": stats.STATISTICS,
    "terrain_attributes": ["slope", "aspect", "max_curvature"],
}
ACCURACY = {
    "inputs": {"reference_elev": SOURCE, "to_be_aligned_elev": SOURCE, "path_to_mask": None, "sampling_grid": "reference_elev"},
    "geoids": None,
    "outputs": OUTPUTS,
    "coregistration": {"process": True, "step_one": {"method": "NuthKaab", "extra_information": {}}},
    "statistics": stats.STATISTICS,
}
STEPS = ["step_one", "step_two", "step_three"]


def load_config(path: str) -> dict:
    """A YAML file; the text None stands for a missing value."""
    import yaml

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return None if v == "None" else v

    with open(path) as f:
        return plain(yaml.safe_load(f) or {})


def validate(config: dict, schema: dict) -> dict:
    """The configuration with defaults, or an error that names what is wrong.

    inputs of the topography job are one source, a list of sources, or a source under reference_elev. Statistics or attributes
    that are given as none are not computed. Attributes are a list, or names with the options of each."""
    errors: list[str] = []

    def merge(given, default, at: str):
        if isinstance(default, dict) and not at.endswith(".extra_information"):
            given = {} if given is None else given
            if not isinstance(given, dict):
                errors.append(f"{at or 'the configuration'} must hold names and values")
                return default
            steps = at == "coregistration"
            for k in given:
                if k not in default and not (steps and k in STEPS):
                    errors.append(f"unknown field {at + '.' if at else ''}{k}")
            out = {k: merge(given[k], v, f"{at}.{k}".lstrip(".")) if k in given else copy.deepcopy(v) for k, v in default.items()}
            return out | {k: v for k, v in given.items() if steps and k in STEPS and k not in out}
        if given is None and at in ("statistics", "terrain_attributes"):
            return []
        return copy.deepcopy(default) if given is None and default is not None and at not in ("inputs.sampling_grid", "coregistration.step_one.method") else given

    config = dict(config)
    if "terrain_attributes" in schema:
        given = config.get("inputs")
        if isinstance(given, list) or (isinstance(given, dict) and "path_to_elev" in given):
            listed = given if isinstance(given, list) else [given]
            config["inputs"] = None
            out = merge(config, schema, "")
            out["inputs"] = [merge(s, SOURCE, f"inputs.{k}") for k, s in enumerate(listed)]
            if not listed:
                errors.append("inputs hold no source")
        else:
            out = merge(config, schema, "")
    else:
        out = merge(config, schema, "")
    inputs = out["inputs"]
    for name, source in enumerate(inputs) if isinstance(inputs, list) else inputs.items():
        if isinstance(source, dict):
            if not source.get("path_to_elev"):
                errors.append(f"inputs.{name}.path_to_elev is missing")
            for k in ("from_vcrs", "to_vcrs"):
                if source.get(k) is not None:
                    try:
                        vertical.parse(source[k])
                    except (ValueError, TypeError) as e:
                        errors.append(f"inputs.{name}.{k}: {e}")
    errors += [f"unknown statistic {s}" for s in out["statistics"] if s not in stats.STATISTICS]
    errors += [f"unknown attribute {a}" for a in out.get("terrain_attributes", []) if a not in terrain.ALL]
    if out["outputs"]["level"] not in (1, 2):
        errors.append("outputs.level is 1 or 2")
    if "coregistration" in out:
        errors += [f"unknown method {s.get('method')}" for s in _steps(out) if s.get("method") not in METHODS]
        grids = ("reference_elev", "to_be_aligned_elev")
        if inputs["sampling_grid"] not in (*grids, None):
            errors.append(f"inputs.sampling_grid is one of {', '.join(grids)}")
        elif inputs["sampling_grid"] is None and out["coregistration"]["process"]:
            errors.append("inputs.sampling_grid is needed where surfaces are aligned")
        if out["coregistration"]["process"] and not _steps(out):
            errors.append("coregistration holds no step")
    if errors:
        raise ValueError("; ".join(errors))
    return out


def _steps(config: dict) -> list[dict]:
    """The steps of an alignment in order; those without a method are left out."""
    given = [config["coregistration"].get(k) for k in STEPS]
    return [s for s in given if s and s.get("method") is not None]


def _load(spark: SparkSession, source: dict, grid: Grid | None, geoids: dict | None) -> Raster:
    """A source: cells of its mask are missing, and heights are those of the vertical reference that is asked for."""
    raster = Raster.open(spark, source["path_to_elev"], grid, source.get("from_vcrs"), int(source.get("downsample") or 1), source.get("force_source_nodata"))
    if source.get("path_to_mask"):
        raster = raster.set_mask(_cells(spark, source["path_to_mask"], int(source.get("downsample") or 1), raster.grid.sized(raster.df)))
    target = source.get("to_vcrs")
    if target is not None and vertical.parse(target) != raster.grid.vcrs:
        known = {name: g if isinstance(g, tuple) else files.open_raster(spark, g) for name, g in (geoids or {}).items()}
        raster = raster.to_vcrs(target, known, source.get("from_vcrs"))
    return raster


def _cells(spark: SparkSession, path: str, downsample: int, grid: Grid) -> DataFrame:
    """Cells of a mask: those that outlines cover in the surface's grid, or (row, col; where it has a column z, those with a
    value other than 0) thinned like the surface."""
    if path.lower().endswith(outlines.ENDINGS):
        return outlines.mask(outlines.read(spark, path), grid)
    if path.lower().endswith(files.TIFF):
        df, _ = files.open_raster(spark, path, None, downsample)
        return df.where("coalesce(z, 0) != 0").select(*KEY)
    mask = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    if "z" in mask.columns:
        mask = mask.where("coalesce(cast(z as double), 0) != 0")
    mask = mask.select(*KEY)
    return thin(mask, downsample) if downsample > 1 else mask


def topo(spark: SparkSession, config: dict, grid: Grid | None = None, write: bool = True, geoids: dict | None = None) -> dict:
    """Statistics of the surface and of its attributes, the attributes, and mean profiles.

    Of a list of several sources each has its own outputs: dem_0, dem_1 and so on, as dictionaries and as folders. Geoids
    (name to a raster and its grid, or to an ASCII grid's path) are needed where a source has to_vcrs. Attributes are always
    returned; their cells are written at level 2."""
    c = validate(config, TOPO)
    geoids = geoids or c["geoids"]
    sources = c["inputs"] if isinstance(c["inputs"], list) else list(c["inputs"].values())
    jobs = {}
    for k, source in enumerate(sources):
        path = c["outputs"]["path"] if len(sources) == 1 else f"{c['outputs']['path']}/dem_{k}"
        out = _topo(_load(spark, source, grid, geoids), c["statistics"], c["terrain_attributes"])
        jobs[f"dem_{k}"] = _write(out, path, () if c["outputs"]["level"] > 1 else ("attributes",)) if write else out
    return jobs["dem_0"] if len(sources) == 1 else jobs


def _topo(raster: Raster, names: list[str], attributes: list[str] | dict) -> dict[str, DataFrame]:
    out = {"statistics": stats.statistics(raster.df, "z", names)} if names else {}
    if attributes:
        out["attributes"] = _attributes(raster, attributes)
        for n in attributes if names else ():
            out[f"statistics_{n}"] = stats.statistics(out["attributes"], n, names)
    out["profile_rows"], out["profile_columns"] = stats.profiles(raster.df, "row"), stats.profiles(raster.df, "col")
    return out


def _attributes(raster: Raster, attributes: list[str] | dict) -> DataFrame:
    """The attributes in their order; those with the same options are computed together."""
    if not isinstance(attributes, dict):
        return raster.get_terrain_attribute(attributes)
    groups: dict[str, tuple[list, dict]] = {}
    for name, options in attributes.items():
        groups.setdefault(repr(sorted((options or {}).items())), ([], options or {}))[0].append(name)
    parts = [raster.get_terrain_attribute(names, **options) for names, options in groups.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEY)
    return out.select(*KEY, *attributes)


def accuracy(spark: SparkSession, config: dict, grid: Grid | None = None, write: bool = True, geoids: dict | None = None) -> dict[str, DataFrame]:
    """The aligned surface, differences before and after, and their statistics and histograms.

    At level 2 also both surfaces as they were aligned, their statistics, and what the alignment changed. inputs.path_to_mask
    holds cells that no fit may use; a source's own path_to_mask makes its cells missing."""
    c = validate(config, ACCURACY)
    geoids, names, more = geoids or c["geoids"], c["statistics"], c["outputs"]["level"] > 1
    ref, tba = (_load(spark, c["inputs"][k], grid, geoids) for k in ("reference_elev", "to_be_aligned_elev"))
    sampling = c["inputs"]["sampling_grid"]
    if tba.grid.transform != ref.grid.transform:
        if sampling is None:
            raise ValueError("the surfaces have different grids: inputs.sampling_grid must name one")
        if sampling == "to_be_aligned_elev":
            ref = ref.reproject(tba)
        else:
            tba = tba.reproject(ref)
    inlier = None
    if c["inputs"]["path_to_mask"]:
        inlier = masks.exclude(ref.df, _cells(spark, c["inputs"]["path_to_mask"], 1, ref.grid.sized(ref.df)))
    before = ref - tba
    out = {"dh_before": before} | ({"statistics_before": stats.statistics(before, "dh", names)} if names else {})
    if more:
        out |= {"reference_elev": ref.df, "to_be_aligned_elev": tba.df}
        if names:
            out |= {f"statistics_{k}": stats.statistics(out[k], "z", names) for k in ("reference_elev", "to_be_aligned_elev")}
    if c["coregistration"]["process"]:
        steps = [METHODS[s["method"]](**(s.get("extra_information") or {})) for s in _steps(c)]
        aligned, _fit = tba.coregister_3d(ref, steps[0] if len(steps) == 1 else align.Pipeline(steps), inlier)
        after = ref - aligned
        out |= {"aligned": aligned.df, "dh_after": after}
        if more:
            out["dh_aligned"] = aligned - tba
        if names:
            out |= {"statistics_after": stats.statistics(after, "dh", names), "statistics_aligned": stats.statistics(aligned.df, "z", names)}
        both = before.select("dh", F.lit("before").alias("k")).unionByName(after.select("dh", F.lit("after").alias("k")))
        out["histogram"] = _histograms(both)
    return _write(out, c["outputs"]["path"]) if write else out


def _histograms(both: DataFrame, n: int = 300) -> DataFrame:
    """Counts before and after in the same bins."""
    ends = both.agg(F.min("dh").alias("lo"), F.max("dh").alias("hi"))
    index = F.least(F.lit(n - 1), F.floor((F.col("dh") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * n).cast("int"))
    return both.where("dh is not null").crossJoin(F.broadcast(ends)).groupBy("k", index.alias("bin")).count()


def _write(out: dict[str, DataFrame], path: str, without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    for name, df in out.items():
        if name in without:
            continue
        if name.startswith("statistics"):
            files.write_statistics(df, f"{path}/{name}.csv")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return out


def main(arguments: list[str] | None = None) -> None:
    """``topo`` or ``accuracy`` with a configuration, or with --template a configuration to start from."""
    import yaml

    parser = argparse.ArgumentParser(prog="talus", description=__doc__)
    parser.add_argument("job", choices=["topo", "accuracy"])
    parser.add_argument("config", nargs="?")
    parser.add_argument("--template", action="store_true")
    parser.add_argument("--output", help="a folder in place of the configuration's")
    a = parser.parse_args(arguments)
    if a.template:
        print(yaml.safe_dump(json.loads(json.dumps(TOPO if a.job == "topo" else ACCURACY)), sort_keys=False))
        return
    if not a.config or not os.path.exists(a.config):
        parser.error("a configuration file is needed")
    from talus.session import share_package

    spark = share_package(SparkSession.builder.getOrCreate())
    config = load_config(a.config)
    if a.output:
        config["outputs"] = (config.get("outputs") or {}) | {"path": a.output}
    {"topo": topo, "accuracy": accuracy}[a.job](spark, config)


if __name__ == "__main__":
    main()
