"""Supersession rules: a later event of the trigger type overrides one of the target type in the same scope."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    trigger_type: str
    target_type: str
    scope: tuple[str, ...]


# The rules of three domains and of the test events (fixed values).
COMPLIANCE = [
    Rule("R1", "blackout_announced", "pre_clearance_approved", ("security_ticker",)),
    Rule("R2", "blackout_lifted", "blackout_announced", ("security_ticker",)),
    Rule("R3", "emergency_exception", "blackout_announced", ("security_ticker", "employee_id")),
    Rule("R4", "exception_revoked", "emergency_exception", ("security_ticker", "employee_id")),
    Rule("R5", "watchlist_added", "pre_clearance_approved", ("security_ticker",)),
    Rule("R6", "watchlist_removed", "watchlist_added", ("security_ticker",)),
    Rule("R7", "conflict_amended", "conflict_disclosed", ("employee_id", "counterparty")),
    Rule("R8", "conflict_cleared", "conflict_disclosed", ("employee_id", "counterparty")),
    Rule("R9", "conflict_cleared", "conflict_amended", ("employee_id", "counterparty")),
    Rule("R10", "policy_updated", "policy_acknowledged", ("policy_id",)),
]
SECURITY = [
    Rule("R_CVE1", "patch_released", "cve_disclosed", ("security_ticker",)),
    Rule("R_CVE2", "patch_superseded", "patch_released", ("security_ticker",)),
    Rule("R_CVE3", "cve_reopened", "patch_released", ("security_ticker",)),
    Rule("R_CVE4", "workaround_issued", "cve_disclosed", ("security_ticker", "employee_id")),
]
LEGAL = [
    Rule("R_LEG1", "ruling_overruled", "ruling_issued", ("employee_id",)),
    Rule("R_LEG2", "ruling_codified", "ruling_issued", ("security_ticker",)),
    Rule("R_LEG3", "ruling_overruled", "ruling_codified", ("security_ticker",)),
]
EVENTS = [
    Rule("D1", "error", "purchase", ("user_id",)),
    Rule("D2", "signup", "error", ("user_id",)),
    Rule("D3", "purchase", "view", ("user_id",)),
    Rule("D4", "click", "view", ("user_id", "k")),
]


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules, if no type overrides itself by way of others: only then do chains end."""
    after: dict[str, set[str]] = {}
    for r in rules:
        after.setdefault(r.target_type, set()).add(r.trigger_type)

    def walk(kind: str, seen: tuple[str, ...]) -> None:
        if kind in seen:
            raise ValueError(f"rules form a cycle: {' > '.join((*seen, kind))}")
        for t in after.get(kind, ()):
            walk(t, (*seen, kind))

    for kind in after:
        walk(kind, ())
    return rules


def depth(rules: list[Rule]) -> int:
    """The longest chain of rules."""
    checked(rules)
    after: dict[str, set[str]] = {}
    for r in rules:
        after.setdefault(r.target_type, set()).add(r.trigger_type)
    longest = lambda kind: max((1 + longest(t) for t in after.get(kind, ())), default=0)
    return max(map(longest, after), default=0)
