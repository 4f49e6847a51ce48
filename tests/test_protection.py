"""Branch protection by hand-made documents."""

from __future__ import annotations

import json

from tessera.operators import protection as P

GOOD = {
    "required_signatures": {"enabled": True}, "required_linear_history": True, "enforce_admins": {"enabled": True}, "allow_force_pushes": {"enabled": False},
    "required_pull_request_reviews": {"required_approving_review_count": 2, "dismiss_stale_reviews": True, "require_code_owner_reviews": True}, "required_status_checks": {"contexts": ["a", "b"]},
}


def findings(spark, docs, files=()):
    p = spark.createDataFrame([(r, x if isinstance(x, str) or x is None else json.dumps(x)) for r, x in docs], "repo string, doc string")
    f = spark.createDataFrame(list(files), "repo string, path string, content string")
    return sorted(tuple(r) for r in P.protection_findings(p, f).select("repo", "rule", "detail").collect())


def test_protection(spark):
    owned = [("good", "docs/CODEOWNERS", "# x\n * @a\n")]
    assert findings(spark, [("good", GOOD)], owned) == []
    # an owners' file of comments, or at another place, is none
    assert findings(spark, [("good", GOOD)], [("good", "CODEOWNERS", "# x\n\n"), ("good", "src/CODEOWNERS", "* @a"), ("other", "CODEOWNERS", "* @a")]) == [("good", "BP005", "")]
    assert findings(spark, [("bare", {})]) == [("bare", r, "0" if r == "BP003" else "") for r in ("BP001", "BP002", "BP003", "BP006")]
    odd = {**GOOD, "required_pull_request_reviews": {"required_approving_review_count": "two"}, "allow_force_pushes": True, "allow_deletions": {"enabled": True}, "enforce_admins": False, "required_signatures": True}
    assert findings(spark, [("odd", odd)], owned) == [("odd", "BP001", ""), ("odd", "BP003", "0"), ("odd", "BP004", ""), ("odd", "BP006", ""), ("odd", "BP007", "force-push and deletion")]
    # not protected, an error, no JSON, no object: silent
    assert findings(spark, [("a", {"message": "Branch not protected"}), ("b", "{broken"), ("c", "[]"), ("d", None), ("e", "7")]) == []


def test_phantoms(spark):
    docs = [("r", json.dumps(GOOD)), ("s", json.dumps({"required_status_checks": {"checks": [{"context": "x"}, {"context": None}, {"context": "x"}]}})), ("unseen", json.dumps(GOOD)), ("none", "{}")]
    rule = {"type": "required_status_checks", "parameters": {"required_status_checks": [{"context": "a"}, {"context": "p"}, {"context": "p"}]}}
    sets = [("r", {"enforcement": "active", "target": "branch", "rules": [rule, {"type": "deletion"}]}), ("r", {"enforcement": "evaluate", "target": "branch", "rules": [rule]}), ("s", {"enforcement": "active", "target": "tag", "rules": [rule]}), ("s", {"message": "no"}), ("t", {"enforcement": "active", "target": "branch"})]
    # a ran on main long ago and on a pull request now; commits without any check count among the newest
    checks = [("r", "main", 1, "a"), *[("r", "main", k, "b") for k in (2, 3)], *[("r", "main", k, None) for k in (4, 5, 6)], ("r", "pull", 1, "a"), ("s", "main", 1, None), ("none", "main", 1, "z")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    p, s = frame(docs, "repo string, doc string"), frame([(r, json.dumps(x)) for r, x in sets], "repo string, doc string")
    c = frame(checks, "repo string, on string, seq long, name string")
    got = sorted(tuple(r) for r in P.phantom_contexts(p, s, c).collect())
    assert got == [("r", "BP008", "high", "a"), ("r", "BP009", "critical", "p"), ("s", "BP008", "high", "x")]
    assert P.phantom_contexts(p.limit(0), s.limit(0), c.limit(0)).isEmpty()
