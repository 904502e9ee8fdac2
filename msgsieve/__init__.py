"""Batch and streaming jobs on Spark for message-threat analytics.

Every public function takes DataFrames (or a session and a path) and returns a
DataFrame; nothing here collects data to the driver.
"""

__version__ = "0.1.0"
