"""Column-returning functions: hash uniforms, special functions, binning."""
