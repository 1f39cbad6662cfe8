"""``python -m scanforge run|runs|extract CONFIG...``: whole analyses, those of a table of several runs, or peaks of finished ones; one JSON file for each job."""

from __future__ import annotations

import argparse

from scanforge.plans.pipeline import Config, extract_peaks, run_batch
from scanforge.plans.runs import run_job
from scanforge.session import session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scanforge", description=__doc__)
    parser.add_argument("command", choices=["run", "runs", "extract"])
    parser.add_argument("configs", nargs="+")
    parser.add_argument("--n-peaks", type=int, default=1)
    parser.add_argument("--run-column", default="run")
    given = parser.parse_args(args)
    spark = session()
    jobs = [Config.read(spark, path) for path in given.configs]
    if given.command == "run":
        run_batch(spark, jobs)
    for job in jobs:
        if given.command == "runs":
            run_job(spark, job, given.run_column, given.n_peaks)
        elif given.command == "extract":
            extract_peaks(spark, job, given.n_peaks)


if __name__ == "__main__":
    main()
