"""sitegrove: versioned web-content processing on Spark DataFrames.

Sub-packages
------------
sources    readers for the given tables, the engine tables derived from them,
           crawl-event parsing and the content store
functions  column expressions: scalars, text cleaning, prompt builders
operators  DataFrame -> DataFrame jobs: catalog queries, change detection,
           document assembly, scheduling, table maintenance
streaming  Structured Streaming jobs over crawl events
plans      the registered queries and their SQL oracles
"""

AS_OF = "2024-02-01 00:00:00"
