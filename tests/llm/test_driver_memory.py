"""A run of many steps leaves no garbage in the driver."""

from ostrakon.llm.common import materialise


def full_collections(jvm):
    beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())


def test_each_step_frees_the_drivers_memory(spark):
    jvm = spark.sparkContext._jvm
    before = full_collections(jvm)
    assert materialise(spark.range(10), "step").count() == 10
    assert full_collections(jvm) > before
