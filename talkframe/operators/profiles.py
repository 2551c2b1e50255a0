"""Patient profiles and cognitive diagrams.

Profiles arrive as JSON text; they are parsed with a fixed schema (keys with
spaces are ordinary struct fields) and rendered with one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions.text import py_strip
from talkframe.schemas import CCD, PROFILE

# Placeholder answers blanked out (exact, lower-cased) and
# fragments that blank a value wherever they occur.
PLACEHOLDERS = ["", "not specified", "unknown", "n/a"]
PLACEHOLDER_FRAGMENTS = ["cannot be identified", "cannot be determined", "not mention", "not exhibited"]

# Profile template order of the rendered fields.
PROFILE_FIELDS = [
    ("name", "name"), ("gender", "gender"), ("age", "age"), ("marital_status", "marital status"),
    ("occupation", "occupation"), ("situation_of_the_client", "situation of the client"),
    ("counseling_history", "counseling history"), ("resistance_toward_the_support", "resistance toward the support"),
]
TAIL_FIELDS = [("depression_severity", "depression severity"), ("suicidal_ideation_severity", "suicidal ideation severity"),
               ("homicidal_ideation_severity", "homicidal ideation severity")]


def json_field(doc: Column, key: str) -> Column:
    """One field of a JSON object held as text (keys may contain spaces)."""
    return F.get_json_object(doc, f"$['{key}']")


def blank_placeholder(v: Column) -> Column:
    """P13: '' for null, placeholder answers and 'cannot be …'/'not mention…' values."""
    low = F.lower(F.coalesce(v, F.lit("")))
    cond = low.isin(*PLACEHOLDERS)
    for frag in PLACEHOLDER_FRAGMENTS:
        cond = cond | F.contains(low, F.lit(frag))
    return F.when(v.isNull() | cond, F.lit("")).otherwise(v)


def parse_profile(doc: Column) -> Column:
    return F.from_json(doc, PROFILE)


def severity_buckets(severity: Column) -> list[Column]:
    """Map keys (lower-cased) whose value mentions mild / moderate / severe
    (a value may land in several buckets), in the order of the map."""
    out = []
    for level in ("mild", "moderate", "severe"):
        keys = F.map_keys(F.map_filter(severity, lambda k, v: F.contains(F.lower(v), F.lit(level))))
        out.append(F.transform(keys, lambda k: F.lower(k)).alias(f"{level}_symptoms"))
    return out


def exhibited_distortions(distortions: Column) -> Column:
    """Distortions whose value does not say 'not exhibited'."""
    keys = F.map_keys(F.map_filter(distortions, lambda k, v: ~F.contains(F.lower(v), F.lit("not exhibited"))))
    return F.transform(keys, lambda k: F.lower(k))


def _profile_values(p: Column) -> dict[str, Column]:
    """Cleaned scalar fields: lower-cased but for the counseling history and the
    severities, placeholders blanked."""
    out = {}
    for name, key in PROFILE_FIELDS:
        raw = F.coalesce(p[key], F.lit(""))
        out[name] = blank_placeholder(raw if key == "counseling history" else F.lower(raw))
    for name, key in TAIL_FIELDS:
        out[name] = blank_placeholder(p[key])
    return out


def _section(title: str, levels) -> Column:
    """A title line and one indented line for each (level, names) entry."""
    none = F.array().cast("array<string>")

    def listed(level, names):
        return F.transform(F.coalesce(names, none), lambda x: F.concat(F.lit("  - "), x, F.lit(f": {level}\n")))
    lines = F.concat(*[listed(*x) for x in levels])
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"- {title}\n"), F.array_join(lines, "")))


def render_profile(profiles: DataFrame, col: str = "profile") -> DataFrame:
    """The profile section of the prompt and the profile dictionary.

    ``- name: value`` for every field that is not blank; the symptoms under one
    title, severe before moderate before mild; the exhibited distortions under
    one title (without any, the template's own placeholder stays in the text);
    then the three severities."""
    p = F.col("_p")
    df = profiles.withColumn("_p", parse_profile(F.col(col)))
    values = _profile_values(p)
    mild, moderate, severe = severity_buckets(p["symptom severity"])
    distortions = exhibited_distortions(p["cognition distortion exhibition"])
    line = lambda name: F.when(values[name] != "", F.concat(F.lit(f"- {name.replace('_', ' ')}: "), values[name], F.lit("\n"))).otherwise("")
    symptoms = _section("symptom severity", [("severe", severe), ("moderate", moderate), ("mild", mild)])
    shown = _section("cognition distortion exhibition", [("exhibited", distortions)])
    prompt = F.concat(*[line(n) for n, _ in PROFILE_FIELDS], F.coalesce(symptoms, F.lit("")),
                      F.coalesce(shown, F.lit("${cognition_distortion_exhibition}")), *[line(n) for n, _ in TAIL_FIELDS])
    none = F.array().cast("array<string>")
    overall = F.coalesce(p["depression severity"], F.lit(""))  # the dictionary keeps it unchecked
    entries = F.struct(*[(overall if n == "depression_severity" else v).alias(n) for n, v in values.items()],
                       F.coalesce(mild, none).alias("symptom_severity_mild"), F.coalesce(moderate, none).alias("symptom_severity_moderate"),
                       F.coalesce(severe, none).alias("symptom_severity_severe"), F.coalesce(distortions, none).alias("cognitive_distortion"))
    return df.select(*profiles.columns, prompt.alias("profile_prompt"), entries.alias("profile_dict"))


def flatten_ccd(df: DataFrame, ccd_col: str = "ccd", style_col: str | None = None, styles: DataFrame | None = None) -> DataFrame:
    """The prompt fields of a cognitive diagram: life history, core belief
    (core_beliefs, else its description), both intermediate beliefs, coping, the
    first cognitive model or blanks; with ``style_col`` the style (blank: plain),
    its description out of the caller's ``styles(style, style_description)``
    by lower-cased name, and the instruction line made of both."""
    c = F.from_json(F.col(ccd_col), CCD)
    first = F.try_element_at(c["cognitive_models"], F.lit(1))
    text = lambda x: F.coalesce(x, F.lit(""))
    out = df.select("*", text(c["life_history"]).alias("life_history"),
                    F.coalesce(F.nullif(c["core_beliefs"], F.lit("")), c["core_belief_description"], F.lit("")).alias("core_belief"),
                    text(c["intermediate_beliefs"]).alias("intermediate_belief"),
                    text(c["intermediate_beliefs_during_depression"]).alias("intermediate_belief_depression"),
                    text(c["coping_strategies"]).alias("coping_strategies"),
                    *[text(first[k]).alias(k) for k in ("situation", "automatic_thoughts", "emotion", "behavior")])
    if style_col is None:
        return out
    style = py_strip(F.coalesce(F.nullif(F.col(style_col), F.lit("")), F.lit("plain")))
    out = out.withColumn("patient_style", style)
    if styles is None:
        out = out.withColumn("style_description", F.lit(None).cast("string"))
    else:
        known = styles.select(F.lower("style").alias("_style_key"), "style_description")
        out = out.join(known, F.lower("patient_style") == F.col("_style_key"), "left").drop("_style_key")
    described = F.nullif(F.col("style_description"), F.lit(""))
    return out.withColumn("style_instruction", F.concat(F.lit("1. "), F.col("patient_style"),
                                                        F.coalesce(F.concat(F.lit("\n - "), described), F.lit(""))))
