"""DataFrame -> DataFrame operators, parameterised by column names."""
