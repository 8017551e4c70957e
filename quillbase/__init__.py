"""A small analytics engine on PySpark: strict SQL front end, DataFrame operators, versioned tables."""
