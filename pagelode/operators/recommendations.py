"""Event-sourced recommendations: ids, priority, replay, summary, auto-resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import words as W


def make_id(domain: Column, url: Column, source: Column, anchor: Column) -> Column:
    """Stable 12 hex digits; domain and anchor regardless of case, blanks around any part left out."""
    return F.substring(F.sha1(F.concat_ws("|", F.lower(F.trim(domain)), F.trim(url), F.trim(source), F.lower(F.trim(anchor)))), 1, 12)


def priority(severity: Column, confidence: Column, est_clicks: Column, auto_fixable: Column, times_raised: Column) -> Column:
    impact = F.when(severity == "critical", 5.0).when(severity == "high", 4.0).when(severity == "medium", 2.0).otherwise(1.0)
    clicks = F.when(est_clicks > 1, F.least(F.lit(5.0), 1 + F.log10(est_clicks))).otherwise(0.0)
    trust = F.when(confidence == "high", 1.0).when(confidence == "medium", 0.8).otherwise(0.6)
    repeat = F.least(1 + 0.1 * (F.greatest(times_raised, F.lit(1)) - 1), F.lit(1.5))
    raw = F.greatest(impact, clicks) * trust * F.when(auto_fixable, 1.25).otherwise(1.0) * repeat
    return F.floor(raw * 100 + 0.5) / 100


def normalise(recs: DataFrame) -> DataFrame:
    """Incoming recommendations with all fields of the store.

    Missing ones take their defaults, unknown severities and confidences are
    medium, the id follows from domain, url, source and key (else the finding);
    an empty finding is an error. Fields that the input lacks count as missing.
    """
    have = lambda c, kind="string": F.col(c) if c in recs.columns else F.lit(None).cast(kind)
    text = lambda c: F.trim(F.coalesce(have(c), F.lit("")))
    severity, sure = F.lower(have("severity")), F.lower(have("confidence"))
    found = recs.withColumns(
        {
            "domain": F.lower(text("domain")),
            "url": text("url"),
            "source": F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("manual")),
            "key": text("key"),
            "category": F.coalesce(have("category"), F.lit("general")),
            "severity": F.when(severity.isin(*W.SEVERITIES), severity).otherwise("medium"),
            "confidence": F.when(sure.isin("high", "medium", "low"), sure).otherwise("medium"),
            "finding": F.when(text("finding") == "", F.raise_error(F.lit("a recommendation needs a finding"))).otherwise(text("finding")),
            "why": F.coalesce(have("why"), F.lit("")),
            "fix": F.coalesce(have("fix"), F.lit("")),
            "evidence": have("evidence"),
            "auto_fixable": F.coalesce(have("auto_fixable", "boolean"), F.lit(False)),
            "status": F.lit("open"),
            "times_raised": F.lit(1),
            "created": F.lit(0),
            "updated": F.lit(0),
        }
    )
    return found.withColumn("id", make_id(F.col("domain"), F.col("url"), F.col("source"), F.coalesce(F.nullif("key", F.lit("")), "finding")))


#: Detail fields that a repeated raise refreshes where it says something.
DETAILS = ("severity", "confidence", "why", "fix", "evidence", "auto_fixable", "category")


def replay(events: DataFrame, key: list[str]) -> DataFrame:
    """Final state of each recommendation from its events in order of seq.

    events: key, seq, ts, event (raise or status), status, severity; further
    detail fields and a note where the log has them. A raise on a new id opens
    it; another raise counts up, refreshes details that aren't empty and reopens
    done and resolved ones; a status event on an unknown id or with an unknown
    status is ignored.

    The state is a plain aggregate: the last valid status event after the first
    raise decides, unless it closed the finding and a later raise reopened it.
    So partial states merge before the shuffle, however long an id's log is.
    """
    raised = F.col("event") == "raise"
    moved = (F.col("event") == "status") & F.col("status").isin(*W.STATUSES)
    seq = F.col("seq")
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    last = lambda c: F.max_by(c, F.when(raised & text(c).isNotNull(), seq))
    found = [c for c in DETAILS if c in events.columns]
    cells = [
        F.min(F.when(raised, seq)).alias("_born"), F.max(F.when(raised, seq)).alias("_raised"), F.max(F.when(moved, seq)).alias("_moved"),
        F.count_if(raised).alias("times_raised"), F.min_by("ts", F.when(raised, seq)).alias("created"),
        F.max_by("ts", F.when(raised, seq)).alias("_raised_ts"), F.max_by("ts", F.when(moved, seq)).alias("_moved_ts"), F.max_by("status", F.when(moved, seq)).alias("_status"),
        *[last(c).alias(c) for c in found],
    ]
    if "note" in events.columns:
        noted = F.when(moved & text("note").isNotNull(), seq)
        cells += [F.max(noted).alias("_noted"), F.max_by("note", noted).alias("_note")]
    s = events.groupBy(*key).agg(*cells).where("_born is not null")
    counts = F.coalesce(F.col("_moved") > F.col("_born"), F.lit(False))
    later = F.col("_raised") > F.col("_moved")
    status = F.when(~counts | (later & F.col("_status").isin("done", "resolved")), "open").otherwise(F.col("_status"))
    updated = F.when(counts & ~later, F.col("_moved_ts")).otherwise(F.col("_raised_ts"))
    more = [F.when(F.col("_noted") > F.col("_born"), F.col("_note")).alias("last_note")] if "note" in events.columns else []
    return s.select(*key, status.alias("status"), "times_raised", "created", updated.alias("updated"), *found, *more)


def history(events: DataFrame, id_: object, key: str = "id") -> DataFrame:
    """All events of one recommendation, in order."""
    return events.where(F.col(key) == F.lit(id_)).orderBy("seq")


def listed(state: DataFrame, status: str | None = None, severity: str | None = None, include_closed: bool = False) -> DataFrame:
    """Recommendations with a status; without one, those not closed unless ``include_closed``; of one severity if given."""
    if status:
        state = state.where(F.col("status") == status)
    elif not include_closed:
        state = state.where(~F.col("status").isin(*W.CLOSED))
    return state.where(F.col("severity") == severity) if severity else state


def summary(state: DataFrame) -> DataFrame:
    open_ = ~F.col("status").isin(*W.CLOSED)
    return state.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in W.STATUSES],
        *[F.count_if(open_ & (F.col("severity") == s)).alias(f"actionable_{s}") for s in W.SEVERITIES],
        F.count_if(open_).alias("actionable"),
        *([F.count_if(open_ & F.col("auto_fixable")).alias("auto_fixable_open")] if "auto_fixable" in state.columns else []),
    )


def auto_resolved(open_recs: DataFrame, linted: DataFrame, rules_run: DataFrame, firing: DataFrame) -> DataFrame:
    """Open rule findings of linted pages whose rule ran and no longer fires."""
    return open_recs.join(linted.select("url").distinct(), "url", "left_semi").join(rules_run.select("rule_id").distinct(), "rule_id", "left_semi").join(firing.select("url", "rule_id"), ["url", "rule_id"], "left_anti")


def save_lint(state: DataFrame, found: DataFrame, linted: DataFrame, rules_run: DataFrame) -> DataFrame:
    """Events that saving a lint run appends: (url, rule_id, event, kind, status).

    Every finding is raised (kind rec_raised if new, rec_reopened if it was done
    or resolved, else raised_again); open rule findings of linted pages whose
    rule ran and no longer fires are resolved (rec_status). state: url, rule_id,
    status. found: url, rule_id.
    """
    known = state.select("url", "rule_id", F.col("status").alias("was"))
    was = F.col("was")
    kind = F.when(was.isNull(), "rec_raised").when(was.isin("done", "resolved"), "rec_reopened").otherwise("raised_again")
    status = F.when(was.isNull() | was.isin("done", "resolved"), "open").otherwise(was)
    raised = found.select("url", "rule_id").join(known, ["url", "rule_id"], "left").select("url", "rule_id", F.lit("raise").alias("event"), kind.alias("kind"), status.alias("status"))
    gone = auto_resolved(state.where(~F.col("status").isin(*W.CLOSED)), linted, rules_run, found)
    return raised.unionByName(gone.select("url", "rule_id", F.lit("status").alias("event"), F.lit("rec_status").alias("kind"), F.lit("resolved").alias("status")))


def saved(state: DataFrame, events: DataFrame) -> DataFrame:
    """Counters of a saved run: raised, reopened, resolved, open_total.

    Pages may share an address, so a finding may have several states and events;
    an event counts once, and is open beside each of its states.
    """
    open_ = F.col("status").isin("open", "accepted")
    key = ["url", "rule_id"]
    now = events.groupBy(*key).agg(
        F.count_if(F.col("event") == "raise").alias("raised"), F.count_if(F.col("kind") == "rec_reopened").alias("reopened"), F.count_if(F.col("kind") == "rec_status").alias("resolved"), F.count_if(open_).alias("opened")
    )
    was = state.groupBy(*key).agg(F.count("*").alias("states"), F.count_if(open_).alias("left"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return was.join(now, key, "full_outer").agg(
        *[total(c).alias(c) for c in ("raised", "reopened", "resolved")],
        total(F.coalesce(F.col("opened") * F.coalesce("states", F.lit(1)), "left")).alias("open_total"),
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, before_score, after_score, delta, new_rules, fixed_rules) of changed files; a file without a version before has only new ones.

    before, after: path, score, rules array<string>.
    """
    b = before.select("path", F.col("score").alias("before_score"), F.col("rules").alias("was"))
    j = after.select("path", F.col("score").alias("after_score"), F.col("rules").alias("now")).join(b, "path", "left")
    was = F.coalesce("was", F.array().cast("array<string>"))
    new, fixed = F.sort_array(F.array_except("now", was)), F.sort_array(F.array_except(was, F.col("now")))
    return j.select("path", "before_score", "after_score", (F.col("after_score") - F.col("before_score")).alias("delta"), new.alias("new_rules"), fixed.alias("fixed_rules"))


def order(recs: DataFrame, by: str = "priority") -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return recs.orderBy(F.desc("priority"), rank, "id") if by == "priority" else recs.orderBy(rank, F.desc("updated"), "id")


#: Severities whose new findings fail a change.
FAILING = ("critical", "high")


def gate(before: DataFrame, after: DataFrame, min_score: int | None = 60, max_drop: int | None = 5, mild: list[str] | None = None) -> DataFrame:
    """(path, before_score, after_score, reasons, new_rules) of files that fail; reasons: below_min, dropped, new_findings.

    before, after as for ``compare``. New findings fail a change unless their
    rule is ``mild``, by default all known rules below FAILING severity.
    """
    if mild is None:
        from pagelode.plans.rules import load_rules

        mild = [r.id for r in load_rules() if r.severity not in FAILING]
    j = compare(before, after)
    bad = F.filter("new_rules", lambda x: ~x.isin(*mild)) if mild else F.col("new_rules")
    reasons = [F.when(F.size(bad) > 0, "new_findings")]
    if max_drop is not None:
        reasons.insert(0, F.when(-F.col("delta") > max_drop, "dropped"))
    if min_score is not None:
        reasons.insert(0, F.when(F.col("after_score") < min_score, "below_min"))
    return j.select("path", "before_score", "after_score", F.array_compact(F.array(*reasons)).alias("reasons"), bad.alias("new_rules")).where(F.size("reasons") > 0)


def wins(state: DataFrame, group: str, n: int = 5) -> DataFrame:
    ranked = state.where(F.col("status").isin("done", "resolved")).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("updated"), "id")))
    return ranked.where(F.col("rank") <= n)
