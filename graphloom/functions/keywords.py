"""Keyword predicates over names, and the rule vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' word lists. A trailing underscore asks for the leading token.
OBSERVATION_KEYWORDS = ["get", "read", "fetch", "query", "display", "show", "status", "info", "list", "sensor_", "read_", "get_", "fetch_", "receive_", "sense_", "peek", "sample", "inspect", "view", "describe"]
ACTION_KEYWORDS = ["set", "update", "create", "delete", "send", "push", "execute", "run", "process", "handle", "dispatch", "encode", "decode", "dump", "load", "act_", "send_", "write_", "execute_", "command_", "emit_", "commit", "rollback", "flush", "apply", "perform", "invoke"]
POLICY_KEYWORDS = ["route", "dispatch", "handle", "policy", "decide", "choose", "select", "route_", "policy_", "decide_", "plan", "strategy", "schedule"]
PREFERENCE_KEYWORDS = ["prefer", "prefer_", "reward", "cost", "loss", "utility", "score", "rank", "objective", "target", "goal", "priority", "weight"]
CONTEXT_KEYWORDS = ["context", "ctx", "environ", "env", "session", "state", "store", "registry", "workspace", "namespace", "scope", "arena"]
CONFIG_KEYWORDS = ["config", "configuration", "cfg", "settings", "options", "params", "toml", "yaml", "ini", "env", "dotenv"]
FEATURE_FLAG_KEYWORDS = ["flag", "feature", "toggle", "switch", "experiment", "ab_test", "enabled", "disabled", "rollout", "canary"]
PARAMETER_KEYWORDS = ["param", "parameter", "hyper", "hyperparameter", "threshold", "alpha", "beta", "gamma", "epsilon", "learning_rate", "temperature", "seed"]
STATE_MACHINE_KEYWORDS = ["state", "transition", "machine", "fsm", "automaton", "workflow", "status", "phase", "stage", "mode"]
CIRCUIT_BREAKER_KEYWORDS = ["circuit", "breaker", "fallback", "bulkhead", "half_open", "open_state"]
RETRY_KEYWORDS = ["retry", "backoff", "attempt", "max_retries", "jitter", "exponential"]
SINGLETON_KEYWORDS = ["singleton", "instance", "_instance", "get_instance", "shared", "global_"]
RATE_LIMITER_KEYWORDS = ["rate", "limit", "throttle", "quota", "burst", "leaky_bucket", "token_bucket", "ratelimit", "ratelimiter"]
POLICY_NAMES = ["middleware", "handler", "controller", "manager", "router", "dispatcher", "scheduler", "route", "dispatch", "handle", "select_", "choose_", "decide_", "plan_", "strategy", "orchestrator", "coordinator", "supervisor"]
CONSTRAINT_NAMES = ["validator", "checker", "test_", "assert_", "validate", "check", "cost_", "reward_", "objective_", "loss_", "utility_", "metric"]
CONTEXT_NAMES = ["config", "settings", "env", "options", "params", "env_", "world_", "state_", "context_"]
PARAMETER_NAMES = ["param_", "weight_", "hyperparameter", "learning_rate", "lr", "beta", "gamma", "alpha", "theta", "lambda_"]
PARAMETER_CLASS_NAMES = ["param", "config", "settings", "hyperparameter"]
STATE_NAMES = ["state", "fsm", "stateful", "transitions"]
RETRY_NAMES = ["retry", "backoff", "circuit", "breaker", "timeout", "fallback"]
CIRCUIT_NAMES = ["retry", "fallback", "circuit", "breaker"]
RATE_NAMES = ["rate_limit", "throttle_", "token_bucket", "leaky_bucket", "ratelimit", "quota", "throttle", "backoff"]
RETRY_HINTS = ["backoff", "reattempt", "retries", "retry"]
BRANCH_HINTS = ["branch", "case_", "choose", "decision", "dispatch", "if_", "predicate", "route", "router", "select", "switch", "when_"]
CIRCUIT_HINTS = ["breaker", "circuit", "fuse", "half_open", "open_circuit", "tripped"]

#: Between a lower-case letter and a capital, an acronym and a word, a letter and a digit, a digit and a letter.
BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def tokens(name: str | Column) -> Column:
    """Lower-case words of a snake_case or camelCase name."""
    return F.filter(F.transform(F.split(F.regexp_replace(name, BOUNDARY, "_"), "_"), F.lower), lambda x: x != "")


def token_match(words: Column, keywords: list[str]) -> Column:
    """A bare keyword is any token, one with a trailing underscore the leading token."""
    bare = [k for k in keywords if not k.endswith("_")]
    leading = [k[:-1] for k in keywords if k.endswith("_")]
    out = F.arrays_overlap(words, F.array(*map(F.lit, bare))) if bare else F.lit(False)
    return F.coalesce(out, F.lit(False)) | F.coalesce(F.get(words, 0).isin(leading), F.lit(False)) if leading else F.coalesce(out, F.lit(False))


def contains_any(name: str | Column, parts: list[str]) -> Column:
    lower = F.lower(name)
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(p)) for p in parts])
