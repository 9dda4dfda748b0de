"""DataFrame -> DataFrame operators by family: clinical, catalogue, workload, profile, sensitivity, prep."""
