"""riskpanel: systemic-risk analytics on market panels, as Spark DataFrame jobs."""
