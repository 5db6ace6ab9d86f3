import gc

from clickloom import session


def held_after_a_write(spark):
    """Whether the driver's JVM still holds an object that nothing refers to."""
    ref = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.lang.Object())
    gc.collect()
    session.stored(spark.range(10), "a-table")
    return ref.get() is not None


def test_a_write_has_the_driver_collect_a_grown_heap_only(spark, monkeypatch):
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    assert not held_after_a_write(spark)
    monkeypatch.setattr(session, "HEAP_SHARE", 1.1)
    assert held_after_a_write(spark)
