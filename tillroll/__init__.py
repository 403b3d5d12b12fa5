"""tillroll: retail basket, demand-panel, forecasting and price-elasticity
operators expressed as Spark DataFrame plans.

Every public operator takes Spark DataFrames and returns a lazy DataFrame;
nothing is collected to the driver and nothing loops over items or products.
"""

from tillroll.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
