"""Spark-native evaluation analytics for speech-editing systems.

Everything is ``DataFrame -> DataFrame`` (or ``Column -> Column``): score tables come in, verdicts, roll-ups,
audits and run histories come out. Nothing is collected to the driver.
"""
