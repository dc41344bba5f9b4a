"""The voice catalogue: a small fixed table, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X

# Key, language, label, name, engine, folder or the engine's own voice.
VOICES = [
    ("en_US-lessac-medium", "en", "English", "English — Lessac (Piper, fast)", "piper", "en/en_US/lessac/medium", None),
    ("en_US-hfc_female-medium", "en", "English", "English — HFC Female (Piper, fast)", "piper", "en/en_US/hfc_female/medium", None),
    ("pt_BR-faber-medium", "pt-BR", "Brazilian Portuguese", "Brazilian Portuguese — Faber (Piper, fast)", "piper", "pt/pt_BR/faber/medium", None),
    ("pt_BR-cadu-medium", "pt-BR", "Brazilian Portuguese", "Brazilian Portuguese — Cadu (Piper, fast)", "piper", "pt/pt_BR/cadu/medium", None),
    ("kokoro-en-heart", "en", "English", "English — Heart (Kokoro, quality)", "kokoro", None, "af_heart"),
    ("kokoro-en-michael", "en", "English", "English — Michael (Kokoro, quality)", "kokoro", None, "am_michael"),
    ("kokoro-en-bella", "en", "English", "English — Bella (Kokoro, quality)", "kokoro", None, "af_bella"),
    ("kokoro-pt-dora", "pt-BR", "Brazilian Portuguese", "Brazilian Portuguese — Dora (Kokoro, quality)", "kokoro", None, "pf_dora"),
]
# Each engine's default voice by language.
DEFAULTS = {
    "piper": {"en": "en_US-lessac-medium", "en-us": "en_US-lessac-medium", "pt": "pt_BR-faber-medium", "pt-br": "pt_BR-faber-medium"},
    "kokoro": {"en": "kokoro-en-heart", "en-us": "kokoro-en-heart", "pt": "kokoro-pt-dora", "pt-br": "kokoro-pt-dora"},
}
_SCHEMA = "key string, language string, language_label string, display_name string, engine string, folder string, engine_voice string"


def voices(spark: SparkSession) -> DataFrame:
    """The catalogue, by engine and name."""
    return spark.createDataFrame(VOICES, _SCHEMA).orderBy("engine", "display_name")


def normalized_engine(value: Column) -> Column:
    return F.when(F.lower(X.trimmed(F.coalesce(value, F.lit("")))) == "kokoro", "kokoro").otherwise("piper")


def model_url(base: str, folder: Column, key: Column, suffix: str = ".onnx") -> Column:
    return F.concat_ws("/", F.lit(base), F.btrim(folder, F.lit("/")), F.concat(key, F.lit(suffix)))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def resolved(requested: Column, language: Column, engine: Column) -> Column:
    """The key of the voice to use: the wanted one if the engine has it, else the language's default, else English.

    The catalogue has eight rows, so it is compiled into the expression; no join.
    """
    own = normalized_engine(engine)
    wanted, lang = X.trimmed(F.coalesce(requested, F.lit(""))), F.lower(X.trimmed(F.coalesce(language, F.lit(""))))
    has = F.try_element_at(_map({v[0]: v[4] for v in VOICES}), wanted) == own
    default = lambda e: F.coalesce(F.try_element_at(_map(DEFAULTS[e]), lang), F.when(lang.startswith("pt"), DEFAULTS[e]["pt-br"]), F.lit(DEFAULTS[e]["en"]))
    return F.when(has, wanted).when(own == "kokoro", default("kokoro")).otherwise(default("piper"))


def compatible(voice: Column, engine: Column) -> Column:
    """No voice, auto or an unknown one goes with any engine."""
    own = F.try_element_at(_map({v[0]: v[4] for v in VOICES}), voice)
    return F.coalesce(own == normalized_engine(engine), F.lit(True))


def sql_resolved(requested: str, language: str, engine: str) -> str:
    own = f"CASE WHEN lower(trim(coalesce({engine}, ''))) = 'kokoro' THEN 'kokoro' ELSE 'piper' END"
    known = "CASE {r} ".format(r=f"trim(coalesce({requested}, ''))") + " ".join(f"WHEN '{v[0]}' THEN '{v[4]}'" for v in VOICES) + " END"
    lang = f"lower(trim(coalesce({language}, '')))"
    default = lambda e: f"coalesce(CASE {lang} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFAULTS[e].items()) + f" END, CASE WHEN starts_with({lang}, 'pt') THEN '{DEFAULTS[e]['pt-br']}' END, '{DEFAULTS[e]['en']}')"
    return f"CASE WHEN {known} = {own} THEN trim({requested}) WHEN {own} = 'kokoro' THEN {default('kokoro')} ELSE {default('piper')} END"
