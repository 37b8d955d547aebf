"""DataFrame-in, DataFrame-out operators; nothing here acts on the driver."""
