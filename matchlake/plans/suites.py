"""Rule suites as data, plus the anomaly → detector map of the detection experiment."""

from __future__ import annotations

from ..operators.quality import Rule

# Accepted status lists and outcome labels of the reference suites
# (the two status lists disagree between suites; both are kept as they are).
EXPANDED_STATUSES = ["Match Finished", "Match Postponed", "Match Cancelled", "Match Scheduled", "In Progress"]
GENERATED_STATUSES = ["Match Finished", "Scheduled", "Postponed", "Cancelled"]
RESULT_LABELS = ["HOME_WIN", "AWAY_WIN", "DRAW"]

# The three suites, model -> column -> tests, in declared order. A test
# is a bare name or a one-key map; arguments appear both flat and under "arguments".
BASELINE = {
    "fct_matches": {"match_id": ["unique", "not_null"]},
    "dim_teams": {"team_id": ["unique", "not_null"]},
}

EXPANDED = {
    "fct_matches": {
        "match_id": ["unique", "not_null"],
        "league_id": ["not_null"],
        "season": ["not_null"],
        "match_date": ["not_null"],
        "match_status": ["not_null", {"accepted_values": {"arguments": {"values": EXPANDED_STATUSES}}}],
        "home_team_id": ["not_null", {"relationships": {"arguments": {"to": "ref('dim_teams')", "field": "team_id"}}}],
        "home_team_name": ["not_null"],
        "home_team_score": ["not_null"],
        "away_team_id": ["not_null", {"relationships": {"arguments": {"to": "ref('dim_teams')", "field": "team_id"}}}],
        "away_team_name": ["not_null"],
        "away_team_score": ["not_null"],
    },
    "dim_teams": {
        "team_id": ["unique", "not_null"],
        "team_name": ["not_null", "unique"],
    },
    "fct_training_dataset": {
        "match_id": ["not_null", "unique",
                     {"relationships": {"arguments": {"to": "ref('fct_matches')", "field": "match_id"}}}],
        "match_date": ["not_null"],
        "match_result": ["not_null", {"accepted_values": {"arguments": {"values": RESULT_LABELS}}}],
        "home_team_id": ["not_null", {"relationships": {"arguments": {"to": "ref('dim_teams')", "field": "team_id"}}}],
        "away_team_id": ["not_null", {"relationships": {"arguments": {"to": "ref('dim_teams')", "field": "team_id"}}}],
    },
}

GENERATED_MERGED = {
    "fct_matches": {
        "match_id": ["unique", "not_null"],
        "league_id": ["not_null"],
        "season": ["not_null"],
        "match_date": ["not_null"],
        "match_status": ["not_null", {"accepted_values": {"values": GENERATED_STATUSES}}],
        "home_team_id": ["not_null"],
        "home_team_name": ["not_null"],
        "home_team_score": ["not_null"],
        "away_team_id": ["not_null"],
        "away_team_name": ["not_null"],
        "away_team_score": ["not_null"],
    },
    "dim_teams": {
        "team_id": ["unique", "not_null"],
        "team_name": ["not_null"],
    },
}

# The suites as experiment conditions.
CONDITIONS = {"manual_only": BASELINE, "manual_expanded": EXPANDED, "manual_plus_llm": GENERATED_MERGED}

# Which (test, model, column) notices which injected anomaly.
DETECTORS = {
    "null_dim_teams_team_id": [("not_null", "dim_teams", "team_id")],
    "duplicate_dim_teams_team_id": [("unique", "dim_teams", "team_id")],
    "null_dim_teams_team_name": [("not_null", "dim_teams", "team_name")],
    "null_fct_matches_match_id": [("not_null", "fct_matches", "match_id"),
                                  ("not_null", "fct_training_dataset", "match_id")],
    "duplicate_fct_matches_match_id": [("unique", "fct_matches", "match_id"),
                                       ("unique", "fct_training_dataset", "match_id")],
    "null_fct_matches_match_status": [("not_null", "fct_matches", "match_status")],
    "invalid_fct_matches_match_status": [("accepted_values", "fct_matches", "match_status")],
    "null_fct_matches_home_team_id": [("not_null", "fct_matches", "home_team_id"),
                                      ("not_null", "fct_training_dataset", "home_team_id")],
    "null_fct_matches_away_team_id": [("not_null", "fct_matches", "away_team_id"),
                                      ("not_null", "fct_training_dataset", "away_team_id")],
    "null_fct_matches_match_date": [("not_null", "fct_matches", "match_date"),
                                    ("not_null", "fct_training_dataset", "match_date")],
}


def _ref_name(v):
    s = str(v)
    if s.startswith("ref(") and s.endswith(")"):
        return s[4:-1].strip().strip("'\"")
    return s


def flatten_tree(tree: dict) -> list[Rule]:
    """Suite tree → rules in declared order. Malformed nodes are skipped; a scalar
    argument becomes ``{"value": x}``; ``{"arguments": {...}}`` is unwrapped."""
    out: list[Rule] = []
    if not isinstance(tree, dict):
        return out
    for model, cols in tree.items():
        if not isinstance(cols, dict):
            continue
        for column, tests in cols.items():
            for t in tests or []:
                if isinstance(t, str):
                    out.append(Rule.make(model, column, t))
                elif isinstance(t, dict) and len(t) == 1:
                    name, args = next(iter(t.items()))
                    if isinstance(args, dict) and isinstance(args.get("arguments"), dict):
                        args = args["arguments"]
                    if not isinstance(args, dict):
                        args = {"value": args}
                    if "to" in args:
                        args = {**args, "to": _ref_name(args["to"])}
                    out.append(Rule.make(model, column, name, **args))
    return out


def suite_rules(name: str) -> list[Rule]:
    return flatten_tree(CONDITIONS[name])


def union_rules(conditions: list[str] | dict[str, list[Rule]]) -> tuple[list[Rule], list[tuple[str, int]]]:
    """Distinct rules over several suites + (condition, rule index) membership.

    ``conditions`` are suite names, or a mapping condition → rule list."""
    rules: list[Rule] = []
    index: dict[str, int] = {}
    member: list[tuple[str, int]] = []
    suites = conditions if isinstance(conditions, dict) else {c: suite_rules(c) for c in conditions}
    for c, rs in suites.items():
        for r in rs:
            if r.key not in index:
                index[r.key] = len(rules)
                rules.append(r)
            member.append((c, index[r.key]))
    return rules, member


# Proposals that no suite can run: a column that does not exist and a test nobody knows.
NOT_EXECUTABLE = [Rule.make("fct_matches", "no_such_column", "not_null"), Rule.make("dim_teams", "team_name", "no_such_test")]
