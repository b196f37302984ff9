"""tagweave: Spark-native preparation and evaluation of multi-label text-tagging data.

Every public function maps DataFrame -> DataFrame on Spark SQL expressions;
see README.md for the operator map.
"""

__version__ = "0.1.0"
