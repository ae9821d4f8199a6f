"""rageval: retrieval-augmented-generation evaluation and routing on Spark DataFrames.

Everything is a plain function from DataFrames to a DataFrame. Subpackages:

* ``sources``   - driver tables, derived fixture views, TSV read/write, incremental runs
* ``functions`` - column expressions (tokenisers, scoring formulas, safe division, prompts)
* ``operators`` - retrieval, fusion, consensus, metrics, generation and routing operators
* ``plans``     - end-to-end jobs and the query catalogue used by ``__spark_entry__``
* ``streaming`` - incremental judging of newly arriving run files
"""

__version__ = "0.1.0"
