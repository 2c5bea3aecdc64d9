"""What Python workers keep of the memory of their tasks, and the driver of planning its jobs."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

#: Seconds of a task's output, or of the driver's jobs, after which unused memory goes back.
EVERY_S = 1.0


def hand_back() -> None:
    """Return memory that the allocators of this process keep and nobody uses: Spark keeps idle workers for the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, unused memory handed back now and then and at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - last > EVERY_S:
                    hand_back()
                    last = time.monotonic()
        finally:
            hand_back()

    return wrapped


#: Share of the driver's time that may go into handing memory back.
DRIVER_SHARE = 0.05
_driver_next = float("-inf")


def driver_hands_back(spark: SparkSession) -> bool:
    """``hand_back`` for the driver, its JVM included; False if the last time was just now or the JVM cannot do it.

    Spark deletes the shuffle files and checkpoints of dropped frames when the driver's JVM collects its garbage, which a long
    run of small jobs hardly ever makes it do: that comes first.  Then each exchange of a plan has threads of its own in the driver,
    and the C allocator keeps what each has freed, a few hundred MB after hundreds of exchanges; the command that hands it
    back is the one that ``jcmd`` calls ``System.trim_native_heap``.
    """
    global _driver_next
    began = time.monotonic()
    if began < _driver_next:
        return False
    gc.collect()
    hand_back()
    context = spark.sparkContext
    java = context._jvm.java
    java.lang.System.gc()
    try:
        name = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = context._gateway.new_array(java.lang.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        invoke = next(m for m in java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
        done = True
    except Py4JError:  # a JVM without the command keeps what it has
        done = False
    ended = time.monotonic()
    _driver_next = ended + max(EVERY_S, (ended - began) / DRIVER_SHARE)
    return done
