"""Batches of dating jobs: identities, fingerprints, seeds, resume, statistics, engines."""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The dating programs and the command each is looked for under.
ENGINES = {"mcmctree": "mcmctree", "lsd2": "lsd2", "r8s": "r8s", "treepl": "treePL", "pathd8": "PATHd8", "wlogdate": "launch_wLogDate.py", "mdcat": "md_cat.py"}
MAX_RETRIES = 3

#: Bytes of a program's output that a job's row has.
LOG_BYTES = 1 << 20


def seed_of(domain: Column, base: Column, method: Column) -> Column:
    """The first 32 bits of SHA-256 of ``domain|base|method``."""
    text = F.concat_ws("|", domain.cast("string"), base.cast("string"), method.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts, each with its length, so that no two lists of parts run together; null differs from empty."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]), 256)


def remaining(jobs: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Jobs without a row in the manifest."""
    return jobs.join(done.select(*on), on, "left_anti")


def resumable(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Jobs (sample_id, method, fingerprint) to run: not finished with the same inputs, nor failed MAX_RETRIES times."""
    keys = ["sample_id", "method", "fingerprint"]
    closed = manifest.groupBy(*keys).agg(F.bool_or(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failures"))
    return remaining(jobs, closed.where(F.col("ok") | (F.col("failures") >= MAX_RETRIES)), keys)


def identity_findings(samples: DataFrame) -> DataFrame:
    """Sample ids and output folders that are used twice."""
    a = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_sample").alias("check"), F.col("sample_id").alias("detail"), "n")
    b = samples.groupBy("output_dir").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_output").alias("check"), F.col("output_dir").alias("detail"), "n")
    return a.unionByName(b)


def resident_bytes(group: int) -> int:
    """Memory of all processes of a process group."""
    total = 0
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            if os.getpgid(int(pid)) == group:
                with open(f"/proc/{pid}/statm") as f:
                    total += int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        except (OSError, IndexError):  # it has ended
            continue
    return total


def head_and_tail(path: str, limit: int = LOG_BYTES) -> str:
    """A log's text, or its first and last halves of ``limit`` bytes with what lies between them counted."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if size <= limit:
            return f.read().decode("utf-8", "replace")
        head = f.read(limit // 2)
        f.seek(size - limit // 2)
        return f"{head.decode('utf-8', 'replace')}\n... {size - 2 * (limit // 2)} bytes ...\n{f.read().decode('utf-8', 'replace')}"


def run_engine(command: list[str], files: dict[str, str], timeout: float, made: dict[str, str] | None = None, max_output: int = 1 << 30, max_memory: int = 8 << 30) -> tuple[str, int | None, str, float]:
    """(status, exit code, log, seconds) of one program in a folder of its own that is removed after.  Texts of the files
    that it wrote or changed go to ``made``, by name.

    Its output goes to a file, of which the log has the head and the tail.  A program that takes longer than ``timeout``
    seconds, writes more than ``max_output`` bytes or holds more than ``max_memory`` is ended with all it has started
    (``timeout``, ``output_limit``, ``memory_limit``).  One that isn't installed is ``unavailable``; nothing stands in for
    its result.
    """
    if shutil.which(command[0]) is None:
        return "unavailable", None, f"{command[0]} is not installed", 0.0
    began = time.time()
    with tempfile.TemporaryDirectory() as top:
        folder, log = os.path.join(top, "run"), os.path.join(top, "log")
        os.mkdir(folder)
        for name, text in files.items():
            if os.path.basename(name) != name:
                raise ValueError("file names only")
            with open(os.path.join(folder, name), "w") as f:
                f.write(text)
        status, wait = None, 0.01
        with open(log, "wb") as out:
            p = subprocess.Popen(command, cwd=folder, stdin=subprocess.DEVNULL, stdout=out, stderr=subprocess.STDOUT, start_new_session=True)
            try:
                while p.poll() is None and status is None:
                    time.sleep(wait)
                    wait = min(wait * 1.5, 1.0)
                    if time.time() - began > timeout:
                        status = "timeout"
                    elif os.path.getsize(log) > max_output:
                        status = "output_limit"
                    elif resident_bytes(p.pid) > max_memory:
                        status = "memory_limit"
            finally:
                try:
                    os.killpg(p.pid, signal.SIGKILL)
                except ProcessLookupError:
                    pass
                p.wait()
        for name in sorted(os.listdir(folder)) if made is not None and status is None else ():
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace", newline="") as f:
                    text = f.read()
                if files.get(name) != text:
                    made[name] = text
        text, seconds = head_and_tail(log), time.time() - began
    if status:
        return status, None, text, seconds
    return ("ok" if p.returncode == 0 else "failed"), p.returncode, text, seconds


def run_jobs(jobs: DataFrame, command_for: Callable[[str, str], tuple[list[str], dict[str, str]]] | None = None, timeout: float = 3600) -> DataFrame:
    """(sample_id, method, status, exit_code, log, seconds, files): one task runs one program.  jobs: sample_id, method, input.

    ``files``: the texts of the files that the program wrote, by name.  Two jobs of one sample and method are an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 1:
            raise ValueError(f"{len(pdf)} jobs for {pdf['sample_id'].iloc[0]} and {pdf['method'].iloc[0]}")
        r = pdf.iloc[0]
        command, files = command_for(r["method"], r["input"]) if command_for else ([ENGINES.get(r["method"], r["method"])], {"input.txt": r["input"]})
        made: dict[str, str] = {}
        status, code, log, seconds = run_engine(command, files, timeout, made)
        return pd.DataFrame([(r["sample_id"], r["method"], status, code, log, seconds, made)], columns=["sample_id", "method", "status", "exit_code", "log", "seconds", "files"])

    return jobs.groupBy("sample_id", "method").applyInPandas(run, "sample_id string, method string, status string, exit_code double, log string, seconds double, files map<string,string>")


def error_class(log: Column) -> Column:
    """The first rule that a program's output meets."""
    t = F.lower(log)
    return F.when(t.rlike("out of memory|cannot allocate|std::bad_alloc"), "memory").when(t.rlike("no such file|cannot open|not found"), "missing_file").when(t.rlike("permission denied"), "permission").when(t.rlike("timed? ?out"), "timeout").when(t.rlike("segmentation fault|core dumped"), "crash").when(t.rlike("syntax|parse error|unexpected"), "syntax").when(t.rlike("error|fatal"), "error").otherwise("unknown")


def program_version(banner: Column) -> Column:
    """The dotted version in a program's banner; null where there is none."""
    found = F.regexp_extract(banner, r"(?i)\bversion\s+v?(\d+(?:\.\d+)+)", 1)
    return F.when(found != "", found)


def same_series(wanted: Column, found: Column) -> Column:
    """Whether two versions agree in their first two numbers; true where either can't be told."""
    numbers = lambda v: F.regexp_extract_all(v, F.lit(r"\d+"), 0)
    series = lambda v: F.transform(F.slice(F.concat(numbers(v), F.array(F.lit("0"))), 1, 2), lambda x: x.cast("long"))
    known = (F.size(numbers(wanted)) > 0) & (F.size(numbers(found)) > 0)
    return F.coalesce(~known | (series(wanted) == series(found)), F.lit(True))
