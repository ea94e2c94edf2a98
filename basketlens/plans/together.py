"""Independent steps of a run at the same time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """The results of ``steps``, each in a thread of its own: the jobs of one fill the cores that others leave.

    All steps end before the first error, if any, is raised. Their jobs keep the caller's job group.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        under_way = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [step.result() for step in under_way]
