"""Sources of curves: registered classes and YAML manifests, with one list over both."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlight.curves import NULL_TOKENS, canonical, coerced


class Source:
    """Something that reads points in canonical form."""

    id = name = description = ""
    parameters: Sequence[Mapping] = ()

    def read(self, spark: SparkSession, **values) -> DataFrame:
        raise NotImplementedError


_SOURCES: dict[str, type[Source]] = {}


def register(id: str, name: str, description: str = "", parameters: Sequence[Mapping] = ()):
    """Class decorator; a later class of the same id replaces an earlier one."""

    def add(cls: type) -> type:
        if not (isinstance(cls, type) and issubclass(cls, Source)):
            raise TypeError("only a Source can be registered")
        cls.id, cls.name, cls.description, cls.parameters = id, name, description, parameters
        _SOURCES[id] = cls
        return cls

    return add


def registered() -> list[type[Source]]:
    return list(_SOURCES.values())


REQUIRED = ("id_objeto", "tiempo", "magnitud")

#: Fixed keys of a manifest, with what each is for.
TEMPLATE = """id: my_source            # file name without ending, if left out
nombre: "My source"      # needed: shown in lists of sources
descripcion: "What the table holds."
version_esquema: 1
acceso:
  formato: csv           # csv or parquet
  # ruta_defecto: path   # where the table is, if the caller gives no path
formato_datos: largo     # one row for each observation
mapeo_columnas:          # the table's names for these; the first three are needed
  id_objeto: object_id
  tiempo: mjd
  magnitud: mag
  error: mag_err
  banda: filter          # without it, give banda_fija
  clase_conocida: class
# banda_fija: r          # the band of all observations
unidades:
  offset_tiempo: 0.0     # added to times, so that they come in days
valores_nulos: ["NaN", "null", "", "-999", "-99.9"]
"""


def write_template(path: str) -> None:
    """Writes a manifest to begin from; an existing file is never overwritten."""
    with open(path, "x", encoding="utf-8") as file:
        file.write(TEMPLATE)


def tabular(spark: SparkSession, manifest: Mapping, path: str | None = None) -> DataFrame:
    """Points of a long CSV or parquet table, as a manifest describes it (TEMPLATE shows all its keys).

    Short manifests may also name the file, its format and the time offset at the top: ruta_datos, formato_archivo,
    offset_tiempo; and the class column `clase`. A path given here comes before the manifest's.
    """
    access, units = manifest.get("acceso") or {}, manifest.get("unidades") or {}
    mapping = manifest.get("mapeo_columnas") or {}
    if missing := [c for c in REQUIRED if not mapping.get(c)]:
        raise ValueError(f"the manifest maps no {', '.join(missing)}")
    if not mapping.get("banda") and not manifest.get("banda_fija"):
        raise ValueError("the manifest needs a band column or a fixed band")
    if manifest.get("formato_datos", "largo") != "largo":
        raise ValueError("only the long format can be read")
    kind = access.get("formato") or manifest.get("formato_archivo", "csv")
    path = path or access.get("ruta_defecto") or manifest.get("ruta_datos")
    if kind not in ("csv", "parquet") or not path:
        raise ValueError("a path to a csv or parquet table is needed")
    raw = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
    if absent := [c for c in mapping.values() if c and c not in raw.columns]:
        raise ValueError(f"the table has no {', '.join(absent)}")
    tokens = manifest.get("valores_nulos", NULL_TOKENS)
    kinds = dict(raw.dtypes)

    def number(key: str):
        c = mapping.get(key)
        if not c:
            return F.lit(None).cast("double")
        return coerced(F.col(c), tokens) if kinds[c] == "string" else F.col(c).cast("double")

    text = lambda key: F.col(mapping[key]).cast("string") if mapping.get(key) else F.lit(None).cast("string")
    return canonical(
        raw.select(
            text("id_objeto").alias("id_objeto"),
            (text("banda") if mapping.get("banda") else F.lit(manifest.get("banda_fija"))).alias("banda"),
            (number("tiempo") + float(units.get("offset_tiempo", manifest.get("offset_tiempo", 0.0)))).alias("t"),
            number("magnitud").alias("m"), number("error").alias("e"), text("clase_conocida" if mapping.get("clase_conocida") else "clase").alias("clase"),
            F.monotonically_increasing_id().alias("src_idx"),
        ).where("id_objeto IS NOT NULL")
    )


def nested(frame: DataFrame, bands: Sequence[str] = ("g", "r", "i")) -> DataFrame:
    """Points of a table with one struct of arrays (mjd, target, past_feat_dynamic_real) per band in bands_data."""
    parts = []
    for band in bands:
        b = F.col("bands_data")[band]
        error = F.coalesce(b["past_feat_dynamic_real"], F.transform(b["mjd"], lambda _: F.lit(None).cast("double")))
        zipped = F.arrays_zip(b["mjd"].alias("t"), b["target"].alias("m"), error.alias("e"))
        points = frame.where(b.isNotNull() & (F.size(b["mjd"]) == F.size(b["target"])))
        parts.append(points.select(F.col("sourceid").alias("id_objeto"), F.lit(band).alias("banda"), F.col("class_str").alias("clase"), F.posexplode(zipped).alias("src_idx", "p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return canonical(out.select("id_objeto", "banda", "clase", "src_idx", "p.t", "p.m", "p.e"))


def wide(frame: DataFrame, id_col: str, bands: Mapping[str, tuple[str, str, str | None]], offset: float = 0.0, reject: str | None = None) -> DataFrame:
    """Points of a wide table: for each band its time, magnitude and reject-flag columns; one row becomes up to one point a band."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c else F.lit(True)
    rows = F.array(
        *(
            F.when(no(flag) & no(reject), F.struct(F.lit(band).alias("banda"), (F.col(t).cast("double") + offset).alias("t"), F.col(m).cast("double").alias("m")))
            for band, (t, m, flag) in bands.items()
        )
    )
    out = frame.select(F.col(id_col).cast("string").alias("id_objeto"), F.explode(rows).alias("p")).where("p IS NOT NULL")
    return canonical(out.select("id_objeto", "p.*").where("t IS NOT NULL AND m IS NOT NULL"))


def classed(rows: DataFrame, key: str, pattern: str, classes: DataFrame) -> DataFrame:
    """Rows whose text `key` holds an id, with `id_objeto` and its class from `classes` (id_objeto, clase).

    The id is the first group of `pattern`. Rows without a match and ids without a class are left out; of an id with
    several classes the first by name counts. Spark broadcasts the classes where they are small."""
    found = rows.withColumn("id_objeto", F.nullif(F.regexp_extract(F.col(key).cast("string"), pattern, 1), F.lit("")))
    known = classes.groupBy(F.col("id_objeto").cast("string").alias("id_objeto")).agg(F.min("clase").alias("clase"))
    return found.join(known, "id_objeto")


def declared(folder: str) -> list[dict]:
    """The manifests of a folder by file name; unreadable ones are skipped with a warning, a missing folder has none."""
    import yaml

    found = []
    for path in sorted(p for p in Path(folder).glob("*") if p.suffix in (".yaml", ".yml")) if Path(folder).is_dir() else []:
        try:
            manifest = yaml.safe_load(path.read_text())
            if not manifest.get("nombre") or not manifest.get("mapeo_columnas"):
                raise ValueError("name and column mapping are needed")
            found.append({"id": path.stem} | manifest)
        except Exception as error:  # any broken manifest is only skipped
            warnings.warn(f"{path.name} is skipped: {error}", stacklevel=2)
    return found


def available(folder: str) -> list[tuple[str, str]]:
    """(id, name) of manifests and registered classes; the first of an id counts; in order of name."""
    names: dict[str, str] = {}
    for m in declared(folder):
        names.setdefault(str(m["id"]), str(m["nombre"]))
    for cls in registered():
        names.setdefault(cls.id, cls.name)
    return sorted(names.items(), key=lambda x: x[1])


def typed(parameters: Sequence[Mapping], values: Mapping[str, str]) -> dict:
    """Text values as the parameters' types: numbers, paths (several if split by ;) or text."""
    out = {}
    for p in parameters:
        text = (values.get(p["id"]) or "").strip()
        if not text:
            if p.get("requerido"):
                raise ValueError(f"{p['id']} is needed")
            continue
        if p.get("tipo") == "numero":
            out[p["id"]] = int(text) if text.lstrip("-").isdigit() else float(text)
        elif p.get("tipo") == "ruta_archivo":
            paths = [x.strip() for x in text.split(";") if x.strip()]
            out[p["id"]] = paths if len(paths) > 1 else paths[0]
        else:
            out[p["id"]] = text
    return out
