"""Retry loops: stretches of a session in which a failing command is tried again in nearly the same words."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 60  #: characters of a command that are compared


def head(command: Column) -> Column:
    """What of a command is compared: lower case, runs of digits alike, white space one space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(command)), r"\d+", "#"), r"\s+", " ")
    return F.substring(plain, 1, HEAD)


def saddles(events: DataFrame, least: int = 3, reach: int = 8, alike: float = 0.8) -> DataFrame:
    """session, opened, ended (seq), fails, escaped, injected of every retry loop.

    events has session, seq (their order), command, exit_code, likely_fail, injected; a row with an injected id is no command. A command
    with a code fails if that isn't 0, one without if it is likely to have failed. A loop opens with a failing command and takes
    the failing ones among the next ones in reach whose heads are alike to its own; a success of such a head ends it.
    Ones that another loop took end it too. A session is one group, sorted by Spark.
    """
    told = events.select("session", "seq", head(F.col("command")).alias("head"), "exit_code", "likely_fail", "injected")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        is_command = rows["injected"].isna().to_numpy()
        own = rows[is_command]
        heads, seqs = own["head"].tolist(), own["seq"].tolist()
        known, codes = own["exit_code"].notna().tolist(), own["exit_code"].fillna(0).astype(int).tolist()
        likely = own["likely_fail"].fillna(False).astype(bool).tolist()
        fails = [c != 0 if k else f for k, c, f in zip(known, codes, likely, strict=True)]
        places, found, used = rows["seq"][~is_command].to_numpy(), [], [False] * len(own)
        matcher = SequenceMatcher(autojunk=True)
        for at in (i for i, bad in enumerate(fails) if bad):
            if used[at]:
                continue
            stop = next((j for j in range(at + 1, min(at + 1 + reach, len(heads))) if used[j]), min(at + 1 + reach, len(heads)))
            near = []
            for j in range(at + 1, stop):
                matcher.set_seqs(heads[at], heads[j])
                if heads[at] == heads[j] or matcher.ratio() >= alike:
                    near.append(j)
            out = next((j for j in near if known[j] and codes[j] == 0), None)
            near = near if out is None else near[: near.index(out) + 1]
            tries = [at, *(j for j in near if fails[j])]
            if len(tries) >= least:
                for j in tries:
                    used[j] = True
                first, last = seqs[at], seqs[near[-1]]
                found.append((own["session"].iloc[0], first, last, len(tries), out is not None, int(((places >= first) & (places <= last)).sum())))
        return pd.DataFrame(found, columns=["session", "opened", "ended", "fails", "escaped", "injected"])

    return told.groupBy("session").applyInPandas(run, f"session {dict(events.dtypes)['session']}, opened long, ended long, fails long, escaped boolean, injected long")


def plain_head(command: str) -> str:
    """head() of one command."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", command.strip(" ").lower()))[:HEAD]
