"""Form templates: fields of text forms, values from profiles and suggestions, filling."""

from __future__ import annotations

import pandas as pd
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import ascii_key, clean_label, slug

#: Profile attributes and the field keys that mean them; our own aliases.
ALIASES: dict[str, tuple[str, ...]] = {
    "FullName": ("full_name", "name", "employee_name", "applicant"), "DateOfBirth": ("date_of_birth", "birth_date", "dob"), "PlaceOfBirth": ("place_of_birth", "birthplace"),
    "Nationality": ("nationality", "citizenship"), "IdNumber": ("id_number", "identity_number", "passport_number"), "IdIssuedDate": ("id_issued_date", "issue_date"),
    "IdIssuedPlace": ("id_issued_place", "issued_by"), "JobTitle": ("job_title", "position", "title"), "Department": ("department", "division", "unit"),
    "PhoneNumber": ("phone_number", "phone", "mobile"), "Email": ("email", "e_mail", "email_address"), "Address": ("address", "home_address"),
}
_LABEL = r"[^:\n\{\}_.]{1,80}"


def detect_fields(forms: DataFrame, key: str = "template_id", text: str = "text") -> DataFrame:
    """``key, pos, field, label`` of text forms: ``{{x}}``; ``Label: ____`` (or dots); ``Label:`` at the end of a line. Labels of
    over five words or with a comma don't count; of fields of one key (whatever the case) the first stays. A label can't hold its colon, so
    its run is taken once at each place, never tried shorter."""
    lines = forms.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("_l", "_line"))
    lines = lines.where(F.contains("_line", F.lit(":")) | F.contains("_line", F.lit("{{")))  # no field is without either
    marks = F.transform(F.regexp_extract_all("_line", F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), lambda x: x)
    blanks = F.regexp_extract_all("_line", F.lit(rf"({_LABEL}+):[ \t]*(?:_{{2,}}|\.{{3,}}|…+)"), F.lit(1))
    ends = F.when(F.rlike(F.trim("_line"), F.lit(rf"^{_LABEL}:$")), F.array(F.regexp_replace(F.trim("_line"), ":$", ""))).otherwise(F.array().cast("array<string>"))
    found = lines.select(key, "_l", F.posexplode(F.concat(marks, blanks, ends)).alias("_p", "_x"))
    label = clean_label(F.regexp_replace("_x", r"^[,;\s]+", ""))
    rows = found.select(key, "_l", "_p", label.alias("label"), slug(label).alias("field")).where((F.size(F.split("label", r"\s+")) <= 5) & ~F.contains("label", F.lit(",")) & (F.col("field") != ""))
    w = Window.partitionBy(key, F.lower("field")).orderBy("_l", "_p")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_l", "_p")) - 1).alias("pos"), "field", "label")


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame([(attribute, alias) for attribute, names in ALIASES.items() for alias in names], "attribute string, alias string")


def profile_values(users: DataFrame) -> DataFrame:
    """``username, alias, value``: a row for each alias of a profile's non-blank attributes."""
    profile = F.from_json("profile_json", "map<string,string>")
    rows = users.select("username", F.explode(profile).alias("attribute", "value")).where("trim(value) <> ''")
    return rows.join(F.broadcast(alias_table(users.sparkSession)), "attribute").select("username", "alias", "value")  # the aliases above


def suggestions(raw: Column) -> Column:
    """Map of a model's suggestions: the JSON object from the first ``{`` to the last ``}``."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "map<string,string>")


def suggest(fields: DataFrame, username: str, profiles: DataFrame, ai: DataFrame | None = None, key: str = "template_id") -> DataFrame:
    """Fields with ``suggested_value`` and ``source``: from the profile by normalised key, else from ``ai(field, value)``."""
    own = profiles.where(F.col("username") == username).select(F.col("alias").alias("_k"), F.col("value").alias("_profile"))
    out = fields.withColumn("_k", ascii_key(F.lower("field"))).join(own, "_k", "left")
    out = out.join(ai.select("field", F.col("value").alias("_ai")), "field", "left") if ai is not None else out.withColumn("_ai", F.lit(None).cast("string"))
    source = F.when(F.col("_profile").isNotNull(), "profile").when(F.coalesce("_ai", F.lit("")) != "", "ai").otherwise("")
    return out.select(key, "pos", "field", "label", F.coalesce("_profile", "_ai", F.lit("")).alias("suggested_value"), source.alias("source"))


@F.pandas_udf(T.StringType())
def fill_text(text: pd.Series, values: pd.Series) -> pd.Series:
    """Texts of forms filled from a map of field key to value (as JSON): marks, blanks after a label, and a blank line after a
    label that ends a line."""
    import json

    def key(label: str) -> str:
        bare = re.sub(r"\s+", "_", re.sub(r"^[\-–•* ]+", "", label.strip()).lower())
        return re.sub(r"^_+|_+$", "", re.sub(r"[^\w]", "", bare))

    def one(t: str, raw: str | None) -> str:
        known = {k.lower(): v for k, v in json.loads(raw or "{}").items()}
        out, pending = [], None
        for line in re.split(r"\r?\n", t):
            if pending is not None and (not line.strip() or re.fullmatch(r"[ \t]*(?:_{2,}|\.{3,}|…+)[ \t]*", line)):
                out.append(known[pending])
                pending = None
                continue
            pending = None
            new = re.sub(r"\{\{\s*([^{}]+?)\s*\}\}", lambda m: known.get(key(m.group(1)), m.group(0)), line)
            new = re.sub(rf"({_LABEL}:[ \t]*)(_{{2,}}|\.{{3,}}|…+)", lambda m: m.group(1).rstrip() + " " + known[key(m.group(1).split(":")[0])] if key(m.group(1).split(":")[0]) in known else m.group(0), new)
            if re.fullmatch(rf"{_LABEL}:", new.strip()) and key(new.strip()[:-1]) in known:
                pending = key(new.strip()[:-1])
            out.append(new)
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, v) for t, v in zip(text, values)])


def cache_put(cache: DataFrame, new: DataFrame, keep: int = 500) -> DataFrame:
    """The detection cache after new entries, the newest ``keep`` of it."""
    from docloom.operators.store import keep_newest, upsert

    return keep_newest(upsert(cache, new, "file_hash"), "cached_at", keep, "file_hash")
