"""retenza: retail customer-retention analytics on Spark.

Events -> validated windows -> session state and behavioural signals ->
next best actions -> churn features, model and scores, plus the store's
order, cart, catalogue-search and reporting queries. Every operator is a
DataFrame -> DataFrame function over the DataFrame/SQL API; the same
functions feed batch jobs and Structured Streaming drivers.
"""

__version__ = "0.1.0"
