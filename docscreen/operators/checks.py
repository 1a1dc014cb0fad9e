"""The four checks and the gates, each as columns. Input is the wide form: a column for each field's value, and its
confidence in <field>_conf; <field>_source where it isn't OCR."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen.functions import numbers, text
from docscreen.operators.rules import Rules

def _result(outcome: Column, label: Column, conf: Column, reason: Column) -> Column:
    return F.struct(outcome.alias("outcome"), label.alias("label"), conf.cast("double").alias("confidence"), reason.cast("string").alias("reason"))


def _two(c: Column) -> Column:
    """A number with two places, as text."""
    return F.format_string("%.2f", c.cast("double"))


def list_check(rules: Rules) -> Column:
    """A coded reference list (columns nationality, listed, approved, list_name) in one of three modes."""
    code, conf = F.col("nationality"), F.coalesce("nationality_conf", F.lit(0.0))
    name = F.coalesce("list_name", code)
    approved, listed = F.coalesce("approved", F.lit(False)), F.col("listed")
    none = F.lit(None).cast("string")
    bad = {"ALL_APPROVED": F.lit(False), "BLOCKLIST": listed & ~approved, "ALLOWLIST": ~(listed & approved)}[rules.list_mode]
    why = F.concat(F.lit("Nationality not approved: " if rules.list_mode == "BLOCKLIST" else "Nationality not in approved list: "), name)
    unread = F.coalesce(code, F.lit("")) == ""
    return _result(
        F.when(unread, "REVIEW").when(bad, "FAIL").otherwise("PASS"),
        F.when(unread, "UNREADABLE").when(bad, "NOT_APPROVED").otherwise("APPROVED"),
        conf,
        F.when(unread, "Nationality unreadable or not recognised").when(bad, why).otherwise(none),
    )


def expiry_check(rules: Rules, as_of: Column) -> Column:
    d, conf = F.col("expiry_date"), F.coalesce("expiry_date_conf", F.lit(0.0))
    days = F.datediff(d, as_of)
    state = F.when(d.isNull(), "DATE_NOT_READABLE").when(days < 0, "EXPIRED").when(days <= rules.warn_days, "EXPIRING_SOON").otherwise("VALID")
    iso = F.date_format(d, "yyyy-MM-dd")
    return _result(
        F.when(state == "VALID", "PASS").when(state == "EXPIRED", "FAIL").otherwise("REVIEW"),
        state,
        conf,
        F.when(state == "DATE_NOT_READABLE", "Expiry date unreadable")
        .when(state == "EXPIRED", F.concat(F.lit("Expired ("), iso, F.lit(", "), days, F.lit(" days)")))
        .when(state == "EXPIRING_SOON", F.concat(F.lit("Expiring soon: "), days, F.lit(" days remaining ("), iso, F.lit(")"))),
    )


def _matches(name: Column, words: tuple[str, ...], bounded: bool) -> Column:
    """Whether some word is in a canonical name; bounded ones between blanks, edges or a dot."""
    import re

    if not words:
        return F.lit(False)
    pattern = "|".join("".join("\\" + ch if re.match(r"[^\w\s]", ch) else ch for ch in w) for w in words)
    return name.rlike(rf"(^|\s)({pattern})(\s|$|\.)" if bounded else f"({pattern})")


def with_employer_class(subjects: DataFrame, rules: Rules) -> DataFrame:
    """subjects with employer_class, worked out once for each different employer; ref_type is the reference's word."""
    keys = ["employer_id", "employer_name", "ref_type"]
    told = subjects.select(*keys).distinct().withColumn("__name", F.coalesce(text.canonical(F.col("employer_name")), F.lit("")))
    told = told.withColumn("employer_class", employer_class(rules, F.col("__name"))).select(*(F.col(k).alias(f"__{k}") for k in keys), "employer_class")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return subjects.join(told, same, "left").drop(*(f"__{k}" for k in keys))


def employer_class(rules: Rules, name: Column) -> Column:
    """struct(type, confidence, layer): the reference, then the id's prefix checked against the canonical name, then the
    name."""
    by_name = [("GOVERNMENT", 0.95, "L2", _matches(name, rules.government, False)), ("COMPANY", 0.90, "L3", _matches(name, rules.legal_forms, True)), ("COMPANY", 0.75, "L4", _matches(name, rules.activities, False))]
    by_name += [("INDIVIDUAL", 0.60, "L5", name.rlike("|".join(f"(?:{p})" for p in rules.person_patterns)))] if rules.person_patterns else []
    out = lambda t, c, layer: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), F.lit(c).cast("double").alias("confidence") if not isinstance(c, Column) else c.alias("confidence"), F.lit(layer).alias("layer"))
    named = F.lit(None)
    for kind, conf, layer, hit in reversed(by_name):
        named = F.when((name != "") & hit, out(kind, conf, layer)).otherwise(named)
    prefix = F.lit(None).cast("string")
    for p, kind in rules.id_prefixes:
        prefix = F.when((F.length("employer_id") == 10) & F.col("employer_id").startswith(p), kind).otherwise(prefix)
    against = named["type"].isNotNull() & (named["type"] != prefix) & ~((prefix == "COMPANY") & (named["type"] == "GOVERNMENT"))
    by_id = out(prefix, F.when(against, 0.69).otherwise(0.99).cast("double"), "L0")
    return F.when(F.col("ref_type").isNotNull(), out(F.col("ref_type"), 1.0, "L1")).when(prefix.isNotNull(), by_id).when(named.isNotNull(), named).otherwise(out("UNKNOWN", 0.0, "NONE"))


def employer_check(rules: Rules) -> Column:
    """Needs the column employer_class."""
    c = F.col("employer_class")
    field = F.greatest(F.coalesce("employer_id_conf", F.lit(0.0)), F.coalesce("employer_name_conf", F.lit(0.0)))
    conf = F.round(F.when(field > 0, F.least(c["confidence"], field)).otherwise(c["confidence"]), 2)
    person, known, sure = c["type"] == "INDIVIDUAL", c["type"].isin("COMPANY", "GOVERNMENT"), conf >= rules.individual_threshold
    return _result(
        F.when(person & sure, "FAIL").when(known, "PASS").otherwise("REVIEW"),
        F.when(person | known, c["type"]).otherwise("UNKNOWN"),
        conf,
        F.when(person & sure, "Individual employer").when(person, F.concat(F.lit("Possible individual employer (confidence "), _two(conf), F.lit(")"))).when(~known, "Employer classification unknown"),
    )


def occupation_check(rules: Rules) -> Column:
    """Needs the column match of lookups.occupation_match, and occupation with its raw text as fallback."""
    m, raw = F.col("match"), F.coalesce(F.nullif("occupation", F.lit("")), F.col("occupation_raw"))
    field, score = F.coalesce("occupation_conf", F.lit(0.0)), F.coalesce(m["score"], F.lit(0.0))
    conf = F.round(F.when(field > 0, F.least(score, field)).otherwise(score), 3)
    conf = F.when(m["method"].isin("exact", "alias"), F.greatest(conf, F.lit(0.80))).otherwise(conf)
    weak = score < rules.review_below
    shown = F.when(F.coalesce(m["name_en"], F.lit("")) != "", F.concat(m["name_en"], F.lit(" ("), m["name_ar"], F.lit(")"))).otherwise(m["name_ar"])
    near = F.concat(raw, F.lit(" ≈ "), m["name_ar"], F.lit(" ("), _two(score), F.lit(")"))
    state = (
        F.when(raw.isNull(), "UNREADABLE")
        .when(m.isNull(), "NOT_EXCLUDED" if rules.occupation_model == "BLOCKLIST" else "UNKNOWN")
        .when(~m["eligible"] & (m["method"] == "fuzzy") & weak, "EXCLUDED_FUZZY")
        .when(~m["eligible"], "EXCLUDED")
        .when(weak, "ELIGIBLE_FUZZY")
        .otherwise("ELIGIBLE")
    )
    return _result(
        F.when(state.isin("NOT_EXCLUDED", "ELIGIBLE"), "PASS").when(state == "EXCLUDED", "FAIL").otherwise("REVIEW"),
        state,
        F.when(raw.isNull(), 0.0).otherwise(conf),
        F.when(state == "UNREADABLE", "Occupation unreadable")
        .when(state == "UNKNOWN", F.concat(F.lit("Occupation not in reference list: "), raw))
        .when(state == "EXCLUDED_FUZZY", F.concat(F.lit("Possible excluded occupation: "), near))
        .when(state == "EXCLUDED", F.concat(F.lit("Excluded occupation: "), shown))
        .when(state == "ELIGIBLE_FUZZY", F.concat(F.lit("Fuzzy occupation match: "), near)),
    )


def by_name(rules: Rules) -> Column:
    """The checks as a map from their name, of rows of checked()."""
    return F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"check_{k}").alias("value")) for k in rules.order)))


def checked(subjects: DataFrame, rules: Rules, as_of: Column, more: Mapping[str, Column] | None = None) -> DataFrame:
    """subjects with check_<name> for each check of the rules' order, after the rule over two checks. more: further
    checks by name, which the rules' order may place."""
    out = with_employer_class(subjects, rules)
    made = dict(more or {}) | {"NATIONALITY": list_check(rules), "EXPIRY": expiry_check(rules, as_of), "EMPLOYER": employer_check(rules), "OCCUPATION": occupation_check(rules)}
    identity = F.col("doc_type") == "NATIONAL_ID"
    skip = _result(F.lit("PASS"), F.lit("NOT_APPLICABLE"), F.lit(1.0), F.lit(None))
    cols = {f"check_{k}": F.when(identity, skip).otherwise(v) if k in rules.skipped_for_identity else v for k, v in made.items() if k in rules.order}
    out = out.withColumns(cols)
    if rules.individual_with_eligible == "REVIEW" and {"EMPLOYER", "OCCUPATION"} <= set(rules.order):
        e, o = F.col("check_EMPLOYER"), F.col("check_OCCUPATION")
        both = (e["outcome"] == "FAIL") & (e["label"] == "INDIVIDUAL") & (o["outcome"] == "PASS") & (o["label"] == "ELIGIBLE")
        why = F.concat(F.lit("Individual employer with eligible occupation ("), F.coalesce(F.nullif(F.col("match.name_ar"), F.lit("")), F.col("occupation")), F.lit(") - human decision"))
        out = out.withColumn("check_EMPLOYER", F.when(both, _result(F.lit("REVIEW"), e["label"], e["confidence"], why)).otherwise(e))
    return out


def decided(df: DataFrame, rules: Rules, version: int = 1) -> DataFrame:
    """checked() rows with decision: struct(status, recommendation, reasons, triggers, version, rules_version).

    Gate 0: a poor image ends it; missing and doubtful critical fields and old layouts are triggers. Gate 1: confirmed
    fails reject (or ask for confirmation). Gate 2: anything open goes to a person. Gate 3: all passed.

    Filter the result after it is written, or above history.current(): a predicate on it that is pushed down would
    evaluate the gates' expressions again.
    """
    no = F.array().cast("array<string>")
    gather = lambda xs: F.array_compact(F.array(*xs)) if xs else no

    def field_trigger(f: str) -> Column:
        value = F.col(f).cast("string")
        conf, source = F.coalesce(f"{f}_conf", F.lit(0.0)), F.coalesce(f"{f}_source", F.lit("ocr")) if f"{f}_source" in df.columns else F.lit("ocr")
        return F.when(F.coalesce(value, F.lit("")) == "", f"MISSING_FIELD:{f}").when((source == "ocr") & (conf < rules.min_field_confidence), F.concat(F.lit(f"LOW_CONFIDENCE:{f} ("), _two(conf), F.lit(")")))

    identity = F.col("doc_type") == "NATIONAL_ID"
    fields = F.when(identity, gather([field_trigger(f) for f in rules.identity_critical])).otherwise(gather([field_trigger(f) for f in rules.critical_fields]))
    old = F.when((F.col("layout") == "old") & F.lit(rules.old_layout_action == "REVIEW"), F.lit(f"OLD_LAYOUT: {rules.old_layout_note}"))
    g0 = F.concat(fields, F.array_compact(F.array(old)))
    cs = [(k, F.col(f"check_{k}"), rules.threshold(k)) for k in rules.order]
    fail = lambda c, t, hard: (c["outcome"] == "FAIL") & ((c["confidence"] >= t) if hard else (c["confidence"] < t))
    reasons = gather([F.when(fail(c, t, True), F.coalesce(c["reason"], c["label"])) for _, c, t in cs])
    soft = lambda what: gather([F.when(fail(c, t, False), F.concat(F.lit(f"{k}: "), c["reason"], F.lit(f" ({what} "), _two(c["confidence"]), F.lit(")"))) for k, c, t in cs])
    review = gather([F.when(c["outcome"].isin("REVIEW", "UNKNOWN"), F.concat(F.lit(f"{k}: "), F.coalesce(c["reason"], c["label"]))) for k, c, _ in cs])
    df = df.withColumns({"__g0": g0, "__reasons": reasons, "__unsure": soft("unconfirmed, confidence"), "__open": F.concat(review, soft("low confidence"))})
    poor = F.col("quality") < rules.min_quality
    hard = F.size("__reasons") > 0
    g2 = F.concat("__g0", "__open")
    confirm = F.lit(rules.confirm_rejections)
    status = F.when(poor, "MANUAL_REVIEW").when(hard, F.when(confirm, "MANUAL_REVIEW").otherwise("REJECTED")).when(F.size(g2) > 0, "MANUAL_REVIEW").otherwise("APPROVED" if rules.auto_approve else "MANUAL_REVIEW")
    advice = F.when(poor, "NEEDS_ATTENTION").when(hard, F.when(confirm, "RECOMMEND_REJECT")).when(F.size(g2) > 0, "NEEDS_ATTENTION").when(~F.lit(rules.auto_approve), "RECOMMEND_APPROVE")
    passed = no if rules.auto_approve else F.array(F.lit("ALL_CHECKS_PASSED_AWAITING_HUMAN_APPROVAL"))
    triggers = (
        F.when(poor, F.array(F.concat(F.lit("POOR_IMAGE (quality "), _two(F.col("quality")), F.lit(f" < {rules.min_quality})"))))
        .when(hard, F.concat("__g0", "__unsure", F.when(confirm, F.array(F.lit("HUMAN_CONFIRMATION_REQUIRED"))).otherwise(no)))
        .when(F.size(g2) > 0, g2)
        .otherwise(passed)
    )
    out = F.struct(status.alias("status"), advice.alias("recommendation"), F.when(poor, no).otherwise(F.col("__reasons")).alias("reasons"), triggers.alias("triggers"), F.lit(version).alias("version"), F.lit(rules.version).alias("rules_version"))
    return df.withColumn("decision", out).drop("__g0", "__reasons", "__unsure", "__open")


def validated(df: DataFrame, rules: Rules, as_of: Column) -> DataFrame:
    """Confidences lowered by failed checksums, prefixes and date rules, and the warnings in order."""
    c = lambda f: F.coalesce(f"{f}_conf", F.lit(0.0))
    warnings, conf = [], {}
    for f in ("iqama_no", "employer_id"):
        there = F.coalesce(F.col(f), F.lit("")) != ""
        wrong = there & ~F.col(f).rlike("^[0-9]{10}$")
        bad = there & ~wrong & ~numbers.luhn_ok_10(F.col(f))
        warnings += [F.when(wrong, f"{f}: not 10 digits").when(bad, f"{f}: checksum failed (advisory)")]
        conf[f] = F.when(wrong, F.round(c(f) * 0.5, 3)).when(bad, F.round(c(f) * 0.8, 3)).otherwise(c(f))
    want = F.when(F.col("doc_type") == "NATIONAL_ID", "1").otherwise("2")
    other = (F.coalesce("iqama_no", F.lit("")) != "") & (F.col("iqama_no").substr(1, 1) != want)
    warnings.append(F.when(other, F.concat(F.lit("iqama_no: does not start with "), want, F.lit(" for "), F.col("doc_type"))))
    conf["iqama_no"] = F.when(other, F.round(conf["iqama_no"] * 0.5, 3)).otherwise(conf["iqama_no"])
    b, e = F.col("birth_date"), F.col("expiry_date")
    crossed = F.coalesce(b >= e, F.lit(False))
    young = F.coalesce(~F.year(b).between(1920, F.year(as_of) - 14), F.lit(False))
    far = F.coalesce(~F.year(e).between(2000, 2100), F.lit(False))
    warnings += [F.when(crossed, "birth_date >= expiry_date"), F.when(young, "birth_date out of plausible range"), F.when(far, "expiry_date out of plausible range")]
    after = F.when(crossed, F.round(c("expiry_date") * 0.7, 3)).otherwise(c("expiry_date"))
    conf["expiry_date"] = F.when(far, F.round(after * 0.3, 3)).otherwise(after)
    conf["birth_date"] = F.when(young, F.round(c("birth_date") * 0.5, 3)).otherwise(c("birth_date"))
    critical = lambda fs: F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f"missing critical field: {f}") for f in fs)))
    # each kind of document by its own list, as the decision does
    missing = F.when(F.col("doc_type") == "NATIONAL_ID", critical(rules.identity_critical)).otherwise(critical(rules.critical_fields))
    return df.withColumns({f"{k}_conf": v for k, v in conf.items()} | {"warnings": F.concat(F.array_compact(F.array(*warnings)), missing)})
