import gc

from siftworks.tables import cut


def _collected(jvm):
    """Whole collections of the driver's heap so far."""
    beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in (beans.get(i) for i in range(beans.size())) if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_grown_heap_is_cleared_between_steps(spark):
    jvm = spark.sparkContext._jvm
    runtime, new = jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway.new_array
    held = []
    while runtime.totalMemory() <= runtime.maxMemory() // 2:
        held.append(new(jvm.long, 8 << 20))
    del held
    gc.collect()
    before = _collected(jvm)
    assert cut(spark.range(5)).count() == 5
    assert _collected(jvm) > before


def test_a_small_heap_is_left_alone(spark):
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    runtime.gc()
    assert runtime.totalMemory() <= runtime.maxMemory() // 2
    before = _collected(jvm)
    assert cut(spark.range(5)).count() == 5
    assert _collected(jvm) == before
